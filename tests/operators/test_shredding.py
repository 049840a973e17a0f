from tesserakg.operators.shredding import elements, record_children, shred

SNAK = "struct<snaktype:string,datatype:string,property:string,datavalue:struct<value:struct<id:string>>>"
VALUE = "struct<language:string,value:string>"
SCHEMA = f"line_no long, labels map<string,{VALUE}>, aliases map<string,array<{VALUE}>>, claims map<string,array<struct<mainsnak:{SNAK},rank:string,qualifiers:array<{SNAK}>>>>, node string, parent string, key string"


def snak(kind, item, datatype="wikibase-item"):
    return (kind, datatype, "P1", ((item,),))


def test_children_of_dirty_records(spark):
    """Nulls at every level, null elements that count, empty values, copies, and columns named like the operator's own."""
    rows = [
        (1, {"en": ("en", "A"), "de": ("xx", ""), "fr": None, "it": ("it", None)}, {"en": [("en", "a0"), None, ("en", "a2"), ("en", "")], "de": None, "fr": []},
         {"P31": [(snak("value", "Q1"), "normal", [snak("value", "Q7"), None, snak("novalue", "Q8"), snak("value", "Q9")]), None, (snak("somevalue", None), None, [snak("value", "Q5")]), (None, None, None), (("value", "wikibase-item", "P1", None), "normal", [])], "P2": None}, "clash", "clash", "clash"),
        (2, None, None, None, None, None, None), (3, {}, {}, {}, "x", None, None), (None, {"en": ("en", "N")}, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows + rows[:1], SCHEMA)
    got = sorted(map(tuple, record_children(df).collect()), key=repr)
    wanted = [
        (1, "label", "en", 0, -1, "A"), (1, "alias", "en", 0, -1, "a0"), (1, "alias", "en", 2, -1, "a2"), (1, "claim", "P31", 0, -1, "Q1"),
        (1, "qualifier", "P31", 0, 0, "Q7"), (1, "qualifier", "P31", 0, 3, "Q9"), (1, "qualifier", "P31", 2, 0, "Q5"), (None, "label", "en", 0, -1, "N"),
    ]
    assert got == sorted(wanted, key=repr)


def test_elements_without_scalars_stay(spark):
    df = spark.createDataFrame([(1, {"P1": [((None, None, None, None), None, None), None]})], f"line_no long, claims map<string,array<struct<mainsnak:{SNAK},rank:string,qualifiers:array<{SNAK}>>>>")
    nodes = shred(df, "line_no", ["claims"])
    assert [tuple(x) for x in elements(nodes, {"rank": "rank"}).select("key", "label", "ordinal", "rank").collect()] == [(1, "P1", 0, None)]
    assert nodes.columns == ["key", "node", "parent", "label", "ordinal", "scalar"]


def test_one_scan_and_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert record_children(df).collect() == []
    plan = record_children(spark.read.parquet("/root/testdata/sf0.001/parse_wikidata_dump.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
