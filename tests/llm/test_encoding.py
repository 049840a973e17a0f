import random

from tesserakg.llm.encoding import CHAINS, Language, Prior, garbled, mixed, repair, restored, sites

FRENCH = "L’été a été très agréable à Genève, où l’équipe a fêté son départ.|La société a créé un café près du théâtre.|Le général a dénoncé l’hôpital régional, même après la grève.".split("|")
RUSSIAN = "Экипаж судна закрыл сезон дождей около города.|Министр открыл старую крепость в прошлом году.|Газета осудила итоги выборов, несмотря на морозы.".split("|")
ENGLISH = "The museum didn’t open – “soon,” they said – for €5 million.|An ordinary plain text without anything.|Ångström and naïve, ½ ÷ ¼, 10 µm, √2 ≈ 1.4".split("|")


def corpus():
    """Clean texts, and some garbled ones of each chain, in whole or in part."""
    r = random.Random(1)
    rows, truth, original = [], {}, {}
    for i in range(400):
        text = " ".join(r.choice(x) for x in r.choices([FRENCH, RUSSIAN, ENGLISH], k=1) * 3)
        key, source = i, f"s{i % 7}" if i % 11 else None
        if i % 10 == 3 and not text.isascii():
            chain = r.choice(["cp1252", "cp1251", "mac_roman", "cp437", "koi"])
            try:
                if chain == "koi":
                    bad = text.encode("koi8-r").decode("cp1251")
                elif i % 20 == 3:  # one word only
                    words = text.split(" ")
                    at = r.choice([k for k, w in enumerate(words) if not w.isascii()])
                    words[at] = words[at].encode().decode(chain)
                    bad = " ".join(words)
                else:
                    bad = text.encode().decode(chain)
            except UnicodeError:
                bad = text
            if bad != text:
                truth[key], original[key], text = chain, text, bad
        rows.append((key, text, source))
    rows += [(1000, None, "s1"), (1001, "", None), (1002, "only ascii", "s1"), (None, "cafÃ©", "s1"), (1003, "lost caf\ufffd in the text", "s2"), rows[3]]
    truth[1003] = "lost"
    return rows, truth, original


def test_garbled_texts_are_found_and_restored(spark):
    rows, truth, original = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    out = {x.id: x for x in restored(df).collect()}
    assert set(out) == set(truth)
    assert all(out[k].restored == t for k, t in original.items()) and out[1003].restored is None
    assert {x.id for x in garbled(df).collect()} == set(truth)


def test_clean_and_empty_tables(spark):
    clean = [(i, t, "s") for i, t in enumerate(FRENCH + RUSSIAN + ENGLISH)] * 3
    schema = "doc_id long, text string, source string"
    assert garbled(spark.createDataFrame(clean, schema)).collect() == []
    assert garbled(spark.createDataFrame([], schema)).collect() == []


def test_sites_of_a_run():
    got = {(CHAINS[c], u) for c, _, _, u in sites("Ã©")}
    assert ("utf-8>cp1252", "é") in got and not any(c.endswith("twice") for c, _ in got)
    twice = "š".encode().decode("cp1252").encode().decode("cp1252")
    assert ("utf-8>cp1252 twice", "š") in {(CHAINS[c], u) for c, _, _, u in sites(twice)}
    assert [x[0] for x in sites("\ufffd")] == [1]


def test_prior_leaves_one_record_out():
    p = Prior({3: 1.0}, {0: 10})
    assert p(0, 3) < 1e-3 < p(0, 0) and mixed(-100) < -0.6 and mixed(100) > 98


def test_repair_keeps_lost_texts():
    assert repair("a \ufffd", "lost", Language({"a": 1.0}, {})) is None
