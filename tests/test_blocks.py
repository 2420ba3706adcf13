from tessera.plans import QUERIES


def test_blocks_hold_all_text(spark, tmp_path):
    """Lists, cells, quotes, text behind a block and in bare containers; inline tags, comments and scripts; nothing."""
    html = """Top<h2 class="x">Head <b>bold</b></h2><div>bare<p>para<br/>two</p>tail</div><ul><li>one</li>
<li><p>nested</p></li></ul><TABLE><tr><th>k</th> <th>v</th></tr><tr><td>a</td><td>1</td></tr></TABLE><blockquote>said</blockquote><!-- <p>no</p> --><script>var a = "<p>no</p>";</script>"""
    spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "<p> </p>")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = QUERIES["html_blocks"](spark, str(tmp_path)).orderBy("page_id", "ord").collect()
    assert [(r.kind, r.text) for r in rows] == [
        ("PARA", "Top"), ("HEADING", "Head bold"), ("PARA", "bare"), ("PARA", "para two"), ("PARA", "tail"), ("PARA", "one"), ("PARA", "nested"),
        ("TABLE_ROW", "k | v"), ("TABLE_ROW", "a | 1"), ("PARA", "said"),
    ]
    assert {r.page_id for r in rows} == {1} and [r.ord for r in rows] == list(range(1, 11))
