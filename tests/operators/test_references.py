import datetime as dt

from tesserakg.operators.references import mention_references, orphan_report, orphan_rows, record_facts

ENTITY = "array<struct<page_title:string,offset:int,length:int,mention:string,qid:string,out_of_kg:boolean>>"


def e(qid, out=None):
    return (None, 0, 1, "m", qid, out)


def test_orphans_against_a_plain_walk(spark):
    """A hot id with a third of all references, ids written in several ways, null days, dates and flags, copies, clashing names."""
    day = dt.date(2010, 5, 1)
    known, created, deleted = {"Q1", "Q2", "Q3", "Q4"}, {"Q2": "2011-01-01T00:00:00Z", "Q1": "2000-01-01T00:00:00Z"}, {"Q3": "2010-05-01T00:00:00Z", "Q4": "no date"}
    ids = ["Q1", "q2", "http://x/entity/Q3", "Q4", "Q007", "Q 9", None, "P1", "Q"]
    events = [(i, day if i % 5 else None, [e("Q99"), e(ids[i % 9], None if i % 2 else False), e("Q98", True), None]) for i in range(90)] + [(500, day, None), (501, None, []), (502, dt.date(2012, 1, 1), [e("Q2")])]
    df = spark.createDataFrame([(*x, "z", "z") for x in events + events[:10]], f"docno long, event_date date, entities {ENTITY}, qid string, key string").repartition(3)
    dates = [(q, created.get(q), deleted.get(q)) for q in ["Q1", "Q2", "Q3", "Q4", "Q99"]] + [("Q2", "2013-01-01T00:00:00Z", None), (None, "2000-01-01T00:00:00Z", None)]
    facts = record_facts([spark.createDataFrame([(k,) for k in known], "id string"), spark.createDataFrame([(None,), ("q0001",)], "id string")], spark.createDataFrame(dates, "qid string, created string, deleted string"))
    norm = {"q2": "Q2", "http://x/entity/Q3": "Q3", "Q007": "Q7", "Q 9": "Q9"}
    wanted = set()
    for docno, when, entities in events:
        for pos, x in enumerate(entities or []):
            if x is None or x[4] in (None, "P1", "Q") or x[5]:
                continue
            q = norm.get(x[4], x[4])
            kind = "missing" if q not in known else "deleted" if q == "Q3" and when and when >= dt.date(2010, 5, 1) else "later" if q == "Q2" and when and dt.date(2011, 1, 1) > when else None
            if kind:
                wanted.add((docno, pos, q, kind, when.strftime("%Y-%m") if when else "none"))
    refs = mention_references(df)
    got = [tuple(x) for x in orphan_rows(refs, facts).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted
    report = {(x.period_ym, x.orphan_kind): (x.n_refs, x.n_ids) for x in orphan_report(refs, facts, "t").collect()}
    for key, (n, n_ids) in report.items():
        rows = [w for w in wanted if (w[4], w[3]) == key]
        assert n == len(rows) and n_ids == len({w[2] for w in rows})
    assert len(report) == len({(w[4], w[3]) for w in wanted})


def test_empty_tables(spark):
    events = spark.createDataFrame([], f"docno long, event_date date, entities {ENTITY}")
    facts = record_facts([spark.createDataFrame([], "id string")], spark.createDataFrame([], "qid string, created string, deleted string"))
    assert orphan_rows(mention_references(events), facts).collect() == []
