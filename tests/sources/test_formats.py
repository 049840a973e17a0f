import gzip
import json

from pyspark.sql import functions as F

from tesserakg.sources import readers as R
from tesserakg.sources import writers as W
from tesserakg.sources.html import item_links


def test_dump_round_trip(spark, tmp_path):
    """An array with a record per line, commas, broken lines and another kind of record; compressed."""
    record = {"id": "Q1", "labels": {"de": {"language": "de", "value": "x"}}, "claims": {"P31": [{"mainsnak": {"snaktype": "value", "datatype": "wikibase-item", "property": "P31", "datavalue": {"value": {"id": "Q5"}}}, "rank": "normal"}]}, "lastrevid": 4, "more": 1}
    path = tmp_path / "dump.json.gz"
    with gzip.open(path, "wt") as f:
        f.write("[\n" + json.dumps(record) + ",\n" + '{"id": "Q2", broken,\n' + json.dumps({"labels": {}}) + ",\n" + json.dumps({"id": "P3", "claims": {}}) + "\n]\n")
    got = R.dump(spark, str(path), 3)
    assert sorted(r.id for r in got.collect()) == ["P3", "Q1"]
    row = got.filter("id = 'Q1'").first()
    assert row.claims["P31"][0].mainsnak.datavalue.value.id == "Q5" and row.labels["de"].value == "x" and row.lastrevid == 4 and row.aliases is None
    from tesserakg.operators.kg import reduce_records

    parsed = reduce_records(got).select("id", F.col("label").alias("labels"), F.col("description").alias("descriptions"), "aliases", F.transform("claims", lambda c: F.array(c["property"], c["object"])).alias("claims"))
    W.json_lines(parsed, str(tmp_path / "out"))
    back = {r.id: r for r in R.parsed(spark, str(tmp_path / "out")).collect()}
    assert back["Q1"].labels == "x" and back["Q1"].claims == [["P31", "Q5"]] and back["P3"].labels == ""


def test_dataset_shapes(spark, tmp_path):
    doc = {"docid": "d", "text": "t", "entities": [{"offset": 1, "length": 2, "mention": "m", "qid": "Q1", "out_of_kg": False}]}
    for k, shape in enumerate([[doc, doc], {"test": [doc], "dev": [doc]}, [[doc], [doc]]]):
        (tmp_path / f"{k}.json").write_text(json.dumps(shape, indent=1))
        got = R.dataset(spark, str(tmp_path / f"{k}.json")).collect()
        assert len(got) == 2 and {r.part for r in got} == ({"test", "dev"} if k == 1 else {""}) and got[0].entities[0].offset == 1


def test_token_table_and_spans(spark, tmp_path):
    from tesserakg.operators.datasets import iob_spans

    (tmp_path / "a.tsv").write_text("-DOCSTART- (1 x)\nEU\tB\tEU\tEuropean_Union\thttp://x\t99\nrejects\n\nNew\tB\tNew York\tNYC\nYork\tI\tNew York\tNYC\n-DOCSTART- (2 y)\nRome\tB\tRome\n")
    rows = R.token_table(spark, str(tmp_path / "a.tsv"))
    assert rows.filter("doc_no = 1").count() == 5 and rows.filter("token = 'EU'").first().page_id == "99"
    got = sorted((r.doc_no, r.start, r.len, r.mention) for r in iob_spans(rows).collect() if r.mention)
    assert got == [(1, 0, 2, "EU"), (1, 11, 8, "New York"), (2, 0, 4, "Rome")]


def test_candidate_and_prior_tables(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("d1\td1\tParis\tl\tr\tCANDIDATES\t12,0.5,Paris, Texas\t13,0.25,Paris\tGT:\t2,13,0.25,Paris\nd2\td2\tX\tl\tr\tCANDIDATES\tEMPTYCAND\tGT:\t-1\nbad line\n")
    a, b = R.candidate_table(spark, str(tmp_path / "c.tsv")).orderBy("docid").collect()
    assert [tuple(c) for c in a.candidates] == [("12", 0.5, "Paris, Texas"), ("13", 0.25, "Paris")] and a.gold_index == 1 and a.mention == "Paris"
    assert b.candidates == [] and b.gold_index is None
    (tmp_path / "p.tsv").write_text("Paris\t10\t12,0.5,Paris, Texas\t13,0.2,Paris\tlast\n")
    assert [tuple(r) for r in R.prior_table(spark, str(tmp_path / "p.tsv")).collect()] == [("Paris", 10, "12", 0.5, "Paris, Texas"), ("Paris", 10, "13", 0.2, "Paris")]


def test_means_triples_and_tables(spark, tmp_path):
    (tmp_path / "m.tsv").write_text('"caf\\u00e9"\tCafe\n"caf\\u00e9"\tCaf\\u00e9\nshort\n')
    assert [tuple(r) for r in R.means_table(spark, str(tmp_path / "m.tsv")).collect()] == [("café", ["Cafe", "Café"])]
    (tmp_path / "t.nt").write_text("<http://a/X> <http://www.w3.org/2002/07/owl#sameAs> <http://b/Q%C3%A9> .\n<a> <p> <b> .\n<http://a/Y>\towl:sameAs\t<http://b/Z> .\n")
    assert sorted(map(tuple, R.triples(spark, str(tmp_path / "t.nt"), "sameAs").collect())) == [("http://a/X", "http://b/Qé"), ("http://a/Y", "http://b/Z")]
    (tmp_path / "i.csv").write_text('item_id,en_label\n1,"a, ""b"""\n')
    assert tuple(R.csv_table(spark, str(tmp_path / "i.csv"), "item_id long, en_label string").first()) == (1, 'a, "b"')
    (tmp_path / "k.jsonl").write_text(json.dumps({"page_id": 7, "sections": [{"text": "abc", "link_offsets": [0, 1], "link_lengths": [1, 2], "target_page_ids": [8, 9]}, {"text": "x", "link_offsets": [], "link_lengths": [], "target_page_ids": []}]}) + "\n")
    assert sorted(map(tuple, R.linked_pages(spark, str(tmp_path / "k.jsonl")).collect())) == [(7, 0, "abc", 0, 1, 8), (7, 0, "abc", 1, 2, 9)]


def test_page_links(spark):
    page = '<ul><li>Out <ul><li>A <a href="/wiki/X_%C3%A9">the x</a> b<a href="http://e">no</a></li></ul> <a href="/wiki/Y">y</a></li></ul><a href="/wiki/Z">z</a>'
    assert item_links(page) == [(0, "A the x bno", 2, 5, "X_é", "the x"), (1, "Out  y", 5, 1, "Y", "y")]
    df = spark.createDataFrame([(1, page), (2, None), (3, "<li><a href='/wiki/Q'>q")], "page_id long, html string")
    got = R.page_links(df).collect()
    assert sorted((r.page_id, r.title) for r in got) == [(1, "X_é"), (1, "Y")]


def test_mapped_titles_and_results(spark, tmp_path):
    t = lambda rows, s: spark.createDataFrame(rows, s)
    got = R.mapped_titles(t([("a",), ("b",), ("c",)], "title string"), t([("a", "A")], "from_ string, to_ string"), t([("A", "AA")], "from_ string, to_ string"), t([("AA", "Q1"), ("b", "Q2")], "title string, qid string"))
    assert sorted(map(tuple, got.collect()), key=repr) == [("a", "Q1"), ("b", "Q2"), ("c", None)]
    (tmp_path / "r.json").write_text('{"link": "Q1", "_label_out_of_kg": true}\n{"link": "Q2", "out_of_kg": false}\n')
    assert {(r.link, r.out_of_kg) for r in R.results(spark, str(tmp_path / "r.json")).collect()} == {("Q1", True), ("Q2", False)}
    assert R.filtered_vectors(t([("Q1", [1.0]), ("Q2", [2.0])], "qid string, vec array<double>"), t([("Q2",)], "qid string")).count() == 1


def test_written_texts_and_tables(spark, tmp_path):
    m = spark.createDataFrame([(1, 0, 'say "x"\nb', "Q1", True, 3, 2)], "docno long, pos int, mention string, qid string, ookg boolean, start int, len int")
    line = W.nif_lines(m).first().turtle
    assert "#offset_3_5>" in line and 'nif:anchorOf "say \\"x\\"\\nb"' in line and "OutOfKG" in line
    W.write_text(W.nif_lines(m), "turtle", str(tmp_path / "nif"))
    W.tab_separated(W.evaluator_rows(spark.createDataFrame([(0, "c1")], "place long, label string")), str(tmp_path / "ev"))
    assert spark.read.text(str(tmp_path / "ev")).first()[0] == "0\t0\t1\tc1\t1.0\tMISC" and spark.read.text(str(tmp_path / "nif")).count() == 1
    W.results(m, str(tmp_path / "res"))
    assert spark.read.parquet(str(tmp_path / "res")).count() == 1
    tex = W.booktabs(spark.createDataFrame([("a", 0.5), ("b", 0.25), ("c", None)], "name string, f double"))
    assert "\\textbf{0.500}" in tex and "b & 0.250" in tex and "c & -" in tex


def test_parameters_round_trip(spark, tmp_path):
    W.parameters(spark.createDataFrame([("prior", 1.0), ("degree", 0.5)], "name string, weight double"), str(tmp_path / "w"))
    assert R.parameters(spark, str(tmp_path / "w")) == {"prior": 1.0, "degree": 0.5}
