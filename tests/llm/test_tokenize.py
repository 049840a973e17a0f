import random

from tokenizers import Tokenizer

from tesserakg.llm.tokenize import VOCABULARY, Vocabulary, encode_words, encoder, token_ids

TEXTS = [None, "", " ", "   \n\t ", "Don't  stop", "naïve café — “quoted”", "Привет, мир! 你好 안녕 สวัสดี 😀👩‍🔬", "<|endoftext|> as text", "0123456789 " * 50, "a" * 5000, "\u200b\ufeff\xad", "x\x00y", "don’t’s'll"]


def library(texts):
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return [[] if not x else t.encode(x, add_special_tokens=False).ids for x in texts]


def test_ids_are_the_library_s(spark):
    r = random.Random(1)
    texts = TEXTS + ["".join(r.choice("abc éЖ你 \n.'") for _ in range(r.randrange(80))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, None)], "doc_id long, text string").repartition(3)
    got = sorted((x.doc_id, list(x.ids)) for x in token_ids(df).collect())
    assert got == sorted([(i, ids) for i, ids in enumerate(library(texts))] + [(0, [])])


def test_words_that_share_an_index():
    v = Vocabulary.read(VOCABULARY)
    words = [b"hello", b"", b"aaaa", b" hello", b"aaa", b"hellohello"]
    assert encode_words(words, v) == [encode_words([w], v)[0] for w in words]
    assert encoder(v)(["hello hello", None]) == library(["hello hello", None])


def test_key_of_any_name_and_no_rows(spark):
    out = token_ids(spark.createDataFrame([("k", "hi", 1)], "`a key` string, body string, ids int"), "a key", "body")
    assert out.columns == ["a key", "ids"] and out.collect()[0]["ids"] == library(["hi"])[0]
    assert token_ids(spark.createDataFrame([], "doc_id long, text string")).collect() == []
