"""Mention dictionaries and candidates: priors, lookup with fall-backs, cut-off, gold insertion and quality.

Defined cases: null mentions and null ids are no keys; a missing prior is 0; of several entries of one mention the first
(smallest entry id) holds; mentions without candidates keep a row where a count per mention is asked for; empty tables
give empty results; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserakg.runtime import cut, skew_join


def mention_priors(mentions: DataFrame) -> DataFrame:
    """``mention, qid, n, prior``: how often the lower-case mention means the entity; pairs are counted before any window."""
    pairs = mentions.filter(F.col("mention").isNotNull() & F.col("qid").isNotNull()).groupBy(F.lower("mention").alias("mention"), "qid").agg(F.count("*").alias("n"))
    return pairs.withColumn("prior", F.col("n") / F.sum("n").over(Window.partitionBy("mention")))


def ranked(priors: DataFrame) -> DataFrame:
    """``mention, rank, qid, prior`` in the order of the priors (ties: smaller id)."""
    order = Window.partitionBy("mention").orderBy(F.desc("prior"), "qid")
    return priors.select("mention", (F.row_number().over(order) - 1).cast("int").alias("rank"), "qid", "prior")


def dictionary(entries: DataFrame) -> DataFrame:
    """``mention, rank, qid, prior`` of nested entries; rank is the place in the array."""
    first = entries.filter(F.col("mention").isNotNull()).groupBy("mention").agg(F.min_by("candidates", "entry_id").alias("candidates"))
    return first.select("mention", F.posexplode("candidates").alias("rank", "c")).filter(F.col("c.qid").isNotNull()).select("mention", "rank", "c.qid", F.coalesce("c.prior", F.lit(0.0)).alias("prior"))


def merged(dictionaries: list[DataFrame]) -> DataFrame:
    """Union of dictionaries; of a mention the first one that has it holds, with all its candidates."""
    tagged = None
    for k, d in enumerate(dictionaries):
        d = d.withColumn("source", F.lit(k))
        tagged = d if tagged is None else tagged.unionByName(d)
    first = tagged.groupBy("mention").agg(F.min("source").alias("source"))
    return tagged.join(first, ["mention", "source"]).drop("source")


def lookup(mentions: DataFrame, entries: DataFrame) -> DataFrame:
    """``mention, key, level`` of distinct mentions: the exact key, else the lower-case one, else the lower-cased dictionary's.

    ``level`` is exact, lower, folded or none. The keys of all three are looked up in one join over distinct mentions.
    """
    keys = entries.select(F.col("mention").alias("key")).distinct()
    folded = keys.groupBy(F.lower("key").alias("low")).agg(F.min("key").alias("folded_key"))
    wanted = mentions.filter(F.col("mention").isNotNull()).select("mention", F.lower("mention").alias("low")).distinct()
    exact = keys.select(F.col("key").alias("mention"), F.lit(True).alias("is_exact"))
    lower = keys.select(F.col("key").alias("low"), F.lit(True).alias("is_lower"))
    found = wanted.join(exact, "mention", "left").join(lower, "low", "left").join(folded, "low", "left")
    level = F.when(F.col("is_exact"), "exact").when(F.col("is_lower"), "lower").when(F.col("folded_key").isNotNull(), "folded").otherwise("none")
    key = F.when(F.col("is_exact"), F.col("mention")).when(F.col("is_lower"), F.col("low")).otherwise(F.col("folded_key"))
    return found.select("mention", key.alias("key"), level.alias("level"))


def renormalised(entries: DataFrame) -> DataFrame:
    """Priors divided by their sum per mention where that exceeds 1."""
    total = F.sum("prior").over(Window.partitionBy("mention"))
    return entries.withColumn("prior", F.when(total > 1.0, F.col("prior") / total).otherwise(F.col("prior")))


def cut_off(entries: DataFrame, k: int, keep: DataFrame | None = None) -> DataFrame:
    """The first k candidates of a mention in the dictionary's order (all if k is negative); ids of ``keep`` always stay."""
    if k < 0:
        return entries
    if keep is not None:
        entries = entries.join(keep.select("qid").distinct().withColumn("kept", F.lit(True)), "qid", "left")
    else:
        entries = entries.withColumn("kept", F.lit(None).cast("boolean"))
    order = Window.partitionBy("mention").orderBy("rank")
    # ids that always stay count when they come before the k places are full
    return entries.withColumn("place", F.row_number().over(order)).filter(F.coalesce("kept", F.lit(False)) | (F.col("place") <= k)).drop("kept", "place")


def mention_candidates(mentions: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """``docno, pos, mention, gold, ookg, rank, qid, prior``: lookup, renormalised priors and cut-off for every mention.

    The lookup runs over distinct mentions and distinct keys; its result (at most k rows per distinct mention) is joined
    back to the mentions.
    """
    found = lookup(mentions, entries).filter(F.col("level") != "none")
    chosen = cut_off(renormalised(entries), k).groupBy(F.col("mention").alias("key")).agg(F.sort_array(F.collect_list(F.struct("rank", "qid", "prior"))).alias("cands"))
    by_mention = found.join(chosen, "key").select("mention", "cands")
    base = mentions.filter(F.col("mention").isNotNull() & F.col("qid").isNotNull()).select("docno", "pos", "mention", F.col("qid").alias("gold"), "ookg")
    return skew_join(base, by_mention, "mention", "left").select("docno", "pos", "mention", "gold", "ookg", F.explode_outer("cands").alias("c")).select("docno", "pos", "mention", "gold", "ookg", "c.rank", "c.qid", "c.prior")


def with_gold(rows: DataFrame, k: int) -> DataFrame:
    """Gold inserted where it is missing (a full list loses its last one; prior 0), and removed where it is outside the graph."""
    key = ["docno", "pos", "mention", "gold", "ookg"]
    lists = rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.when(F.col("qid").isNotNull(), F.struct("rank", "qid", "prior")))).alias("cands"))
    has = F.exists("cands", lambda c: c["qid"] == F.col("gold"))
    room = F.when(F.size("cands") >= k, F.slice("cands", 1, k - 1)).otherwise(F.col("cands"))
    gold = F.struct(F.size(room).cast("int").alias("rank"), F.col("gold").alias("qid"), F.lit(0.0).alias("prior"))
    new = F.when(F.col("ookg"), F.filter("cands", lambda c: c["qid"] != F.col("gold"))).when(has, F.col("cands")).otherwise(F.concat(room, F.array(gold)))
    return lists.select(*key, F.posexplode(new).alias("place", "c")).select(*key, F.col("place").cast("int").alias("rank"), "c.qid", "c.prior")


def gold_ranks(mentions: DataFrame, entries: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """``docno, pos, ookg, n_candidates, gold_rank``: place of the gold id among the mention's candidates (from 1; null if none).

    ``excluded`` ids (outside the graph) are taken off the candidates beforehand and don't count as places.
    """
    if excluded is not None:
        entries = entries.join(excluded.select("qid").distinct(), "qid", "left_anti")
    lists = entries.groupBy("mention").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "qid"))), lambda c: c["qid"]).alias("cands"))
    base = mentions.filter(F.col("mention").isNotNull() & F.col("qid").isNotNull()).select("docno", "pos", "mention", "qid", "ookg")
    place = F.array_position("cands", F.col("qid"))
    return skew_join(base, lists, "mention", "left").select("docno", "pos", "ookg", F.coalesce(F.size("cands"), F.lit(0)).alias("n_candidates"), F.when(place > 0, place).alias("gold_rank"))


def candidate_quality(ranks: DataFrame) -> DataFrame:
    """One row: mean rank, mean reciprocal rank, precision, recall and F of the first candidate, and candidate recall."""
    r = F.col("gold_rank")
    s = ranks.agg(
        F.count("*").alias("n"), F.count_if("ookg").alias("n_ookg"), F.count_if(F.col("n_candidates") == 0).alias("n_none"),
        F.count_if((r == 1) & ~F.col("ookg")).alias("correct"), F.avg(r).alias("mean_rank"), F.avg(1 / r).alias("mrr"), F.count_if(r.isNotNull() | F.col("ookg")).alias("hits"), F.count_if(r.isNotNull() & F.col("ookg")).alias("ookg_found"),
    )
    p, q = F.try_divide("correct", F.col("n") - F.col("n_none")), F.try_divide("correct", F.col("n") - F.col("n_none") - F.col("n_ookg"))
    return s.select("n", "n_ookg", "n_none", "correct", F.round("mean_rank", 6).alias("mean_rank"), F.round("mrr", 6).alias("mrr"), F.round(p, 6).alias("precision"), F.round(q, 6).alias("recall"), F.round(F.try_divide(2 * p * q, p + q), 6).alias("f1"), F.round(F.try_divide("hits", "n"), 6).alias("candidate_recall"))


def recall_curve(ranks: DataFrame, most: int = 100) -> DataFrame:
    """``k, recall`` for k = 1 to ``most``: in-graph share of mentions with the gold id among the first k candidates.

    Ranks are counted first, so the curve is computed over at most ``most`` rows.
    """
    total = ranks.agg(F.count_if(~F.col("ookg")).alias("total"))
    counts = ranks.filter(F.col("gold_rank") <= most).groupBy("gold_rank").agg(F.count("*").alias("n"))
    at = counts.select(F.explode(F.sequence("gold_rank", F.lit(most))).alias("k"), "n").groupBy("k").agg(F.sum("n").alias("n"))
    return at.crossJoin(F.broadcast(total)).select(F.col("k").cast("int").alias("k"), F.round(F.try_divide("n", "total"), 6).alias("recall"))


def upfilled(entries: DataFrame, more: DataFrame, k: int, seed: str = "7") -> DataFrame:
    """Known candidates, filled up to k from further ones in a fixed random order; further ones that are known are left out."""
    known = entries.groupBy("mention").agg(F.count("*").alias("n"))
    fresh = more.select("mention", "qid").distinct().join(entries.select("mention", "qid").distinct(), ["mention", "qid"], "left_anti").join(known, "mention", "left")
    order = Window.partitionBy("mention").orderBy(F.md5(F.concat(F.lit(seed), F.lit("|"), "qid")), "qid")
    added = fresh.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k - F.coalesce("n", F.lit(0)))
    return entries.select("mention", "qid", F.lit("known").alias("source")).unionByName(added.select("mention", "qid", F.lit("added").alias("source")))


def with_entities(rows: DataFrame, kg: DataFrame) -> DataFrame:
    """Candidate rows with the graph's label and description; candidates that the graph hasn't are dropped."""
    return rows.join(kg.select(F.col("id").alias("qid"), F.col("labels").alias("label"), F.coalesce("descriptions", F.lit("")).alias("description")), "qid")


def best_candidate(rows: DataFrame) -> DataFrame:
    """``docno, pos, gold, ookg, link, prior``: the candidate of the highest prior (ties: first in the list); null if there is none."""
    key = ["docno", "pos", "gold", "ookg"]
    return rows.groupBy(*key).agg(F.max_by(F.struct("qid", "prior"), F.when(F.col("qid").isNotNull(), F.struct("prior", (-F.col("rank")).alias("r")))).alias("b")).select(*key, F.col("b.qid").alias("link"), F.col("b.prior").alias("prior"))


def token_index(names: DataFrame) -> DataFrame:
    """Inverted index ``token, id, name, n_tokens`` of names."""
    words = F.filter(F.split(F.lower("name"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return names.filter(F.col("name").isNotNull()).select("id", "name", words.alias("w")).filter(F.size("w") > 0).select("id", "name", F.size("w").alias("n_tokens"), F.explode(F.array_distinct("w")).alias("token"))


def _words(c: str) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def fuzzy_candidates(mentions: DataFrame, names: DataFrame, degree: DataFrame, boost: float = 0.1, k: int = 100) -> DataFrame:
    """``mention, qid, score`` of the k best: the share of the mention's words that a name matches, at least half, plus popularity.

    A word matches one of at most 0, 1 or 2 edits by its length (under 3, 3 to 5, more). Of several names of an entity the
    best counts; ``boost * ln(1 + num_claims)`` is added. Words meet over their variants with up to two letters left out, an
    equality join that holds every pair within two edits; the edits are verified.

    A mention's matched words are put in the order of their names' number, the most frequent first. A name is met at the last of
    the words that it matches, and the words up to there (a prefix, at least as long as the matches asked for) are all that its
    score needs. Mentions share prefixes, so each prefix is asked once for its k best, and a frequent word meets its names once
    per prefix that ends in it, not once per mention. Names that k others beat within a prefix are beaten by them in the mention
    as well, since more words only raise the score; so the k best over all prefixes are the mention's.
    """
    asked = mentions.filter(F.col("mention").isNotNull()).select("mention").distinct().withColumn("w", _words("mention")).filter(F.size("w") > 0)
    rows = asked.select("mention", F.size("w").alias("n"), F.explode("w").alias("word"))
    index = token_index(names.filter(~F.col("id").startswith("P")).distinct()).withColumn("tokens", _words("name"))
    met = cut(word_matches(rows.select("word").distinct(), index.select("token").distinct()))
    weight = met.join(index.groupBy("token").agg(F.count("*").alias("names")), "token").groupBy("word").agg(F.sum("names").alias("names"))
    order = F.sort_array(F.collect_list(F.struct("names", "word")), asc=False)
    lists = skew_join(rows, weight, "word").groupBy("mention", "n").agg(F.transform(order, lambda x: x["word"]).alias("w"))
    least = F.ceil(F.col("n") / 2).cast("int")
    prefixes = lists.filter(F.size("w") >= least).select("mention", "n", F.explode(F.transform(F.sequence(least, F.size("w")), lambda j: F.slice("w", 1, j))).alias("prefix"))
    prefixes = cut(prefixes.withColumn("key", F.to_json(F.struct("n", "prefix"))))
    ends = prefixes.select("key", "n", "prefix", F.element_at("prefix", -1).alias("word")).dropDuplicates(["key"])
    hit = F.size(F.filter("prefix", lambda w: F.exists("tokens", lambda t: F.levenshtein(w, t) <= auto_edits(F.length(w)))))
    hits = ends.join(met, "word").join(index, "token").select("key", "n", "id", hit.alias("hit")).filter(F.col("hit") * 2 >= F.col("n"))
    good = hits.groupBy("key", "id").agg(F.max(F.col("hit") / F.col("n")).alias("text_score"))
    scored = good.join(degree.select("id", "num_claims"), "id", "left").withColumn("score", F.round(F.col("text_score") + boost * F.log1p(F.coalesce("num_claims", F.lit(0))), 6))
    best = cut(_first(scored, "key", k).groupBy("key").agg(F.collect_list(F.struct("id", "score")).alias("best")))
    of = skew_join(prefixes.select("mention", "key"), best, "key").select("mention", F.explode("best").alias("b")).select("mention", "b.*")
    return _first(of.repartition("mention").groupBy("mention", "id").agg(F.max("score").alias("score")), "mention", k).select("mention", F.col("id").alias("qid"), "score")


def _first(scored: DataFrame, by: str, k: int) -> DataFrame:
    """The k rows of the highest score (ties: smaller id)."""
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "id"))).filter(F.col("place") <= k).drop("place")


def auto_edits(length: F.Column) -> F.Column:
    """Edits that a word of this length may have."""
    return F.when(length < 3, 0).when(length <= 5, 1).otherwise(2)


def word_matches(words: DataFrame, tokens: DataFrame) -> DataFrame:
    """``word, token`` within the edits allowed to the word, over variants with letters left out."""

    def variants(c: str, most: F.Column) -> F.Column:
        without = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
        one = F.when(F.length(c) > 0, without(F.col(c)))
        two = F.flatten(F.transform(one, lambda x: F.when(F.length(x) > 0, without(x)).otherwise(F.array().cast("array<string>"))))
        empty = F.array().cast("array<string>")
        return F.array_distinct(F.concat(F.array(c), F.when(most >= 1, one).otherwise(empty), F.when(most >= 2, two).otherwise(empty)))

    a = words.select("word", auto_edits(F.length("word")).alias("most")).select("word", "most", F.explode(variants("word", F.col("most"))).alias("v"))
    # a token may be up to two letters longer than the word
    b = tokens.select("token", F.explode(variants("token", auto_edits(F.length("token") + 2))).alias("v"))
    return a.join(b, "v").select("word", "token", "most").distinct().filter(F.levenshtein("word", "token") <= F.col("most")).select("word", "token")


def cluster_candidates(mentions: DataFrame, members: DataFrame, least: float = 0.9, n: int = 5) -> DataFrame:
    """``mention, root, score`` of the n clusters whose best member is most similar to the mention (partial ratio above ``least``).

    Members (``root, mention``) and mentions meet over shared words, an equality join; a partial ratio that high without a whole
    word in common is not looked for. Distinct surfaces are compared once.
    """
    from tesserakg.functions.text import partial_similarity
    from tesserakg.runtime import ship

    ship(mentions.sparkSession)
    words = lambda c: F.explode(F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 2)))
    asked = mentions.filter(F.col("mention").isNotNull()).select("mention").distinct().select("mention", words("mention").alias("word"))
    held = members.filter(F.col("mention").isNotNull()).select("root", F.col("mention").alias("member")).distinct()
    surfaces = held.select("member").distinct().select("member", words("member").alias("word"))
    pairs = asked.join(surfaces, "word").select("mention", "member").distinct().withColumn("score", partial_similarity(F.col("mention"), F.col("member"))).filter(F.col("score") > least)
    best = pairs.join(held, "member").groupBy("mention", "root").agg(F.round(F.max("score"), 6).alias("score"))
    order = Window.partitionBy("mention").orderBy(F.desc("score"), "root")
    return best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).select("mention", "root", "score")
