"""Pages: character references of the registered query are decoded as its SQL does, by the operator as HTML does."""

import duckdb

from evistrata.functions import html
from evistrata.plans import documents

PAGES = [
    '<html lang="en"><head><title>a &amp;&amp; b &quot;c&quot; d&amp</title></head><body><p>&quot;x&quot; &amp;quot; &copy; 1&amp 2 &lt;b&gt;</p></body></html>',
    '<html lang="de"><head><title>plain</title></head><body>a &middot; b<script>"&quot;"</script> &</body></html>',
    "<title></title>",
]


def test_page_texts_decode_what_the_sql_decodes(spark, tmp_path):
    spark.createDataFrame(list(enumerate(PAGES)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert sorted(tuple(r) for r in documents.page_texts(spark, str(tmp_path)).collect()) == sorted(db.execute(documents.ORACLE_SQL["page_texts"]).fetchall())


def test_without_known_references_all_are_decoded():
    assert html.visible(PAGES[0])["title"] == 'a && b "c" d&' and html.visible(PAGES[0])["text"].endswith("1& 2 <b>")
    assert html.visible(PAGES[0], known=(("amp",), ("quot",)))["title"] == "a && b &quot;c&quot; d&amp"
