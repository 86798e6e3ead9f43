import io
import zipfile

import pytest
from pyspark.sql import functions as F

from evistrata.sources import collection
from evistrata.sources.collection import Collected


@pytest.fixture(autouse=True)
def registered(spark):
    spark.dataSource.register(Collected)


def csv(path, ids, end="\n"):
    path.parent.mkdir(exist_ok=True, parents=True)
    path.write_bytes(("id,text" + end + "".join(f'{i},"a, ""{i}"""{end}' for i in ids)).encode())


def read(spark, path, **options):
    r = spark.read.format("collected").option("path", str(path))
    for k, v in options.items():
        r = r.option(k, v)
    return r.load()


@pytest.mark.parametrize("size", [1, 7, 50, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_ranges_of_a_file_give_every_record_once(spark, tmp_path, size, end):
    csv(tmp_path / "in/a.csv", range(12), end)
    (tmp_path / "in/b.csv").write_text("id,text\n99,é")
    (tmp_path / "in/_hidden.csv").write_text("x")
    (tmp_path / "in/empty.csv").write_text("")
    found = read(spark, tmp_path / "in", partition_bytes=size).collect()
    assert sorted((int(r.record["id"]), r.record["text"]) for r in found) == [(i, f'a, "{i}"') for i in range(12)] + [(99, "é")]
    assert len({(r.file, r.pos) for r in found}) == 13


def archive(path, members, **how):
    path.parent.mkdir(exist_ok=True, parents=True)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in members.items():
            z.writestr(name, content)


def test_archives_by_member_and_what_is_refused(spark, tmp_path):
    archive(tmp_path / "ok/x.zip", {"a.csv": "id;n\n1;x\n2;y\n", "dir/b.csv": "id;n\n3;z\n", "note.txt": "no"})
    found = read(spark, tmp_path / "ok", kind="archive", delimiter=";", required="id,n")
    assert sorted((r.record["id"], r.file.rpartition("!")[2]) for r in found.collect()) == [("1", "a.csv"), ("2", "a.csv"), ("3", "dir/b.csv")] and found.rdd.getNumPartitions() == 2
    cases = {
        "too_many_members": ({f"{i}.csv": "id\n" for i in range(4)}, {"most_members": 3}), "packed_too_tightly": ({"a.csv": "id\n" + "0" * 100_000}, {"most_ratio": 50}), "too_large": ({"a.csv": "id\n1\n", "b.csv": "id\n2\n"}, {"most_bytes": 9}),
        "unsafe_member": ({"../a.csv": "id\n"}, {}), "wrong_header": ({"a.csv": "x\n1\n"}, {"required": "id"}), "wrong_row": ({"a.csv": "id,n\n1\n"}, {}),
    }
    for code, (members, options) in cases.items():
        archive(tmp_path / code / "x.zip", members)
        with pytest.raises(Exception, match=code):
            read(spark, tmp_path / code, kind="archive", **options).collect()
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("a.csv", "id\n1\n")
    raw = bytearray(data.getvalue())
    raw[6] |= 1
    raw[raw.rfind(b"PK\x01\x02") + 8] |= 1
    (tmp_path / "locked").mkdir()
    (tmp_path / "locked/x.zip").write_bytes(raw)
    with pytest.raises(Exception, match="encrypted_member"):
        read(spark, tmp_path / "locked", kind="archive").collect()
    with pytest.raises(Exception, match="unknown_kind"):
        read(spark, tmp_path / "ok", kind="other").collect()


def test_feeds_and_site_maps(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f/feed.xml").write_text("<rss><channel><item><title>T</title><link>https://e.org/1</link></item></channel></rss>")
    assert [r.record["link"] for r in read(spark, tmp_path / "f", kind="feed").collect()] == ["https://e.org/1"]
    (tmp_path / "s").mkdir()
    (tmp_path / "s/map.xml").write_text('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://e.org/a</loc></url></urlset>')
    assert [r.record["link"] for r in read(spark, tmp_path / "s", kind="sitemap").collect()] == ["https://e.org/a"]
    assert read(spark, tmp_path / "nowhere").collect() == []


def test_a_stream_resumes_and_a_killed_batch_repeats_its_rows(spark, tmp_path):
    folder, log, seen = tmp_path / "in", str(tmp_path / "log"), []
    stream = lambda: spark.readStream.format("collected").option("path", str(folder)).option("log", log).load()

    def run(sink):
        stream().writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(60)

    def take(batch, number):
        ids = sorted(int(r.record["id"]) for r in batch.collect())
        if ids:
            seen.append((number, ids))

    def dies(batch, number):
        take(batch, number)
        raise RuntimeError("lost")

    csv(folder / "b.csv", [1, 2])
    run(take)
    assert seen == [(0, [1, 2])]
    csv(folder / "a.csv", [3, 4])  # sorts before what came first
    with pytest.raises(Exception, match="lost"):
        run(dies)
    assert collection.checkpoint(log) <= 1  # the sink has not taken it
    csv(folder / "c.csv", [5])  # arrives before the batch is run again
    run(take)
    assert seen[1:3] == [(1, [3, 4]), (1, [3, 4])] and [i for _, ids in seen[3:] for i in ids] in ([], [5])
    run(take)
    assert sorted(i for n, ids in seen[:1] + seen[2:] for i in ids) == [1, 2, 3, 4, 5]
    csv(folder / "d.csv", [6])
    run(take)
    assert seen[-1][1] == [6] and collection.checkpoint(log) >= 3


def test_derived_data(spark, tmp_path):
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    part.select("p_partkey", "p_brand").repartition(3).write.option("header", True).csv(str(tmp_path / "part"))
    found = read(spark, tmp_path / "part", partition_bytes=500).select(F.col("record")["p_partkey"].cast("long").alias("k"), F.col("record")["p_brand"].alias("b"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, part.select("p_partkey", "p_brand").collect()))
