"""Annotated data sets: mentions, marks of entities outside the graph, filters, splits, ordered context and statistics.

A data set has ``docno, text, day, entities``; mentions are its exploded form (see ``mentions``). Defined cases: null entities
make no mention; null flags are false; null ids and days are kept where a rule doesn't need them and decide nothing
otherwise; documents without mentions stay or go as stated; empty tables give empty results. Random choices are ordered by
md5 of a seed and the id, so that they repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserakg.runtime import each_group


def mentions(documents: DataFrame) -> DataFrame:
    """``docno, pos, mention, qid, ookg, day, start, len`` of every marked mention."""
    e = F.col("e")
    return documents.select("docno", "day", F.posexplode("entities").alias("pos", "e")).filter(e.isNotNull()).select("docno", "pos", e["mention"].alias("mention"), e["qid"].alias("qid"), F.coalesce(e["out_of_kg"], F.lit(False)).alias("ookg"), "day", e["offset"].alias("start"), e["length"].alias("len"))


def shuffled(seed: str, key: Column) -> Column:
    """A fixed random number of a key."""
    return F.md5(F.concat(F.lit(seed), F.lit("|"), key.cast("string")))


def in_graph_only(documents: DataFrame) -> DataFrame:
    """Documents with their in-graph mentions; documents without any are dropped."""
    kept = documents.withColumn("entities", F.filter("entities", lambda e: e.isNotNull() & ~F.coalesce(e["out_of_kg"], F.lit(False))))
    return kept.filter(F.size("entities") > 0)


def existing_only(m: DataFrame, kg: DataFrame) -> DataFrame:
    """Mentions whose id is in the graph or that are marked as outside."""
    known = kg.select(F.col("id").alias("qid")).distinct().withColumn("known", F.lit(True))
    return m.join(known, "qid", "left").filter(F.col("known") | F.col("ookg")).drop("known")


def usable_only(m: DataFrame, kg: DataFrame) -> DataFrame:
    """Mentions of known ids with a span that isn't empty."""
    return m.filter(F.col("len") > 0).join(kg.select(F.col("id").alias("qid")).distinct(), "qid", "left_semi")


def sampled_entities(m: DataFrame, share: float, seed: str) -> DataFrame:
    """``qid``: a fixed share of the distinct in-graph ids (rounded down), by the order of their random numbers.

    The threshold is the share's quantile, so nothing is sorted in one task: ids are ranked within 256 ranges of random
    numbers, and the ranges' counts are added up.
    """
    ids = m.filter(F.col("qid").isNotNull() & ~F.col("ookg")).select("qid").distinct().withColumn("r", shuffled(seed, F.col("qid"))).withColumn("part", F.substring("r", 1, 2))
    sizes = ids.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    placed = ids.join(F.broadcast(before), "part").withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("r", "qid")))
    return placed.filter(F.col("place") <= F.floor(F.lit(share) * F.col("total"))).select("qid")


def artificial_ookg(m: DataFrame, sample: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Training mentions without the sampled ids' in-graph mentions; test mentions with these marked as outside."""
    tagged = m.join(sample.select("qid").distinct().withColumn("hit", F.lit(True)), "qid", "left")
    hit = F.coalesce("hit", F.lit(False)) & ~F.col("ookg")
    return tagged.filter(~hit).drop("hit"), tagged.withColumn("ookg", F.col("ookg") | hit).drop("hit")


def ookg_by_creation(ids: DataFrame, created: DataFrame, cutoff: str) -> DataFrame:
    """``qid, ookg``: outside if there is no creation day or it is after the cutoff. ``created`` has one ``created`` day per id."""
    return ids.select("qid").distinct().join(created, "qid", "left").select("qid", (F.col("created").isNull() | (F.col("created") > F.lit(cutoff).cast("date"))).alias("ookg"))


def ookg_by_first_mention(m: DataFrame, created: DataFrame) -> DataFrame:
    """``qid, ookg``: the older rule, outside if created after the first day that mentions it; unknown days decide nothing."""
    first = m.filter(F.col("qid").isNotNull()).groupBy("qid").agg(F.min("day").alias("first"))
    return first.join(created, "qid", "left").select("qid", F.coalesce(F.col("created") > F.col("first"), F.lit(False)).alias("ookg"))


def capitalised_entities(m: DataFrame) -> DataFrame:
    """``qid, ratio`` of the ids of which more than half of the mentions begin with an upper-case letter."""
    first = F.substring("mention", 1, 1)
    upper = ((F.upper(first) == first) & (F.lower(first) != first)).cast("int")
    return m.filter(F.col("qid").isNotNull() & (F.col("mention") != "")).groupBy("qid").agg(F.avg(upper).alias("ratio")).filter(F.col("ratio") > 0.5)


def temporal_split(documents: DataFrame, cutoff: str, seed: str) -> DataFrame:
    """``docno, part``: train up to the cutoff, later documents half dev, half test in a fixed random order; null days are train."""
    rows = documents.select("docno", (F.col("day") > F.lit(cutoff).cast("date")).alias("late")).filter(F.col("docno").isNotNull())
    # halves by the random number's first half, so that no global order is needed
    side = F.when(F.substring(shuffled(seed, F.col("docno")), 1, 1) < "8", "dev").otherwise("test")
    return rows.select("docno", F.when(F.coalesce("late", F.lit(False)), side).otherwise("train").alias("part"))


def annotated(m: DataFrame, marks: DataFrame) -> DataFrame:
    """Mentions with provided marks (``docno, start, mark_qid, mark_ookg``); mentions without one are dropped."""
    return m.join(marks, ["docno", "start"]).select("docno", "pos", "mention", F.col("mark_qid").alias("qid"), F.col("mark_ookg").alias("ookg"))


def resolved(rows: DataFrame, by_page: DataFrame, by_title: DataFrame) -> DataFrame:
    """Rows with ``qid`` by page id (``page_id, id_qid``), else by title (``title, title_qid``); unresolved rows are dropped."""
    return rows.join(by_page, "page_id", "left").join(by_title, "title", "left").withColumn("qid", F.coalesce("id_qid", "title_qid")).filter(F.col("qid").isNotNull()).drop("id_qid", "title_qid")


def document_index(m: DataFrame) -> DataFrame:
    """``qid, n, docs``: number of mentions and the documents (sorted, once each) of every id; arrays of hot ids are cut into parts.

    A part (``part``) holds the documents of one of 64 ranges of random numbers where an id has more than 1,000 mentions.
    """
    counts = m.filter(F.col("qid").isNotNull()).groupBy("qid", "docno").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("qid").agg(F.sum("n").alias("total"))
    part = F.when(F.col("total") > 1000, F.pmod(F.xxhash64("docno"), F.lit(64))).otherwise(0).cast("int")
    return counts.join(sizes, "qid").groupBy("qid", part.alias("part")).agg(F.sum("n").alias("n"), F.sort_array(F.collect_set("docno")).alias("docs"))


# ordered context


def alternating_context(m: DataFrame, size: int) -> DataFrame:
    """``docno, pos, place, other`` of the in-graph neighbours with another id: nearest before, nearest after, next before, ...

    Places are pairs of one before and one after; pairs are taken while fewer than ``size`` neighbours are there, so an odd
    size may give one more. A document's mentions are one group of a window, never of a task's memory.
    """
    base = m.select("docno", "pos", "qid", "ookg")
    near = base.select("docno", F.col("pos").alias("p2"), F.col("qid").alias("other")).filter(~base["ookg"] & F.col("other").isNotNull())
    pairs = base.filter(F.col("qid").isNotNull()).join(near, "docno").filter((F.col("p2") != F.col("pos")) & (F.col("other") != F.col("qid")))
    side = F.when(F.col("p2") < F.col("pos"), 0).otherwise(1)
    per_side = Window.partitionBy("docno", "pos", side).orderBy(F.abs(F.col("p2") - F.col("pos")))
    turn = pairs.withColumn("side", side).withColumn("turn", F.row_number().over(per_side))
    counted = turn.withColumn("before", F.count("*").over(Window.partitionBy("docno", "pos").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)))
    kept = counted.filter(F.col("before") < size)
    return kept.select("docno", "pos", F.row_number().over(Window.partitionBy("docno", "pos").orderBy("turn", "side")).alias("place"), "other")


def preceding_union(rows: DataFrame, k: int) -> DataFrame:
    """``docno, pos, types``: the distinct ``types`` of the k preceding mentions, sorted."""
    w = Window.partitionBy("docno").orderBy("pos").rowsBetween(-k, -1)
    return rows.select("docno", "pos", F.sort_array(F.array_distinct(F.flatten(F.collect_list("types").over(w)))).alias("types"))


def most_active(sequence: DataFrame) -> DataFrame:
    """``max_active`` of ids that have come up and will come up again, over ``at, qid`` in order of ``at``.

    An id is active from its first place until before its last; a sweep over these two places per id.
    """
    ends = sequence.filter(F.col("qid").isNotNull()).groupBy("qid").agg(F.min("at").alias("first"), F.max("at").alias("last")).filter("first < last")
    steps = ends.select(F.col("first").alias("at"), F.lit(1).alias("step")).unionByName(ends.select(F.col("last").alias("at"), F.lit(-1).alias("step"))).groupBy("at").agg(F.sum("step").alias("step"))
    return _running_maximum(steps)


def _running_maximum(steps: DataFrame) -> DataFrame:
    """Maximum of the running sum of ``step`` by ``at``: sums and maxima within ranges of ``at``, then over the ranges."""
    bounds = steps.agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    part = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("at") - F.col("lo")) * 256 / (F.col("hi") - F.col("lo") + 1))).otherwise(0)
    parted = steps.crossJoin(F.broadcast(bounds)).withColumn("part", part)
    within = parted.withColumn("run", F.sum("step").over(Window.partitionBy("part").orderBy("at")))
    ranges = within.groupBy("part").agg(F.sum("step").alias("total"), F.max("run").alias("peak"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranges.select((F.col("peak") + before).alias("peak")).agg(F.coalesce(F.max("peak"), F.lit(0)).cast("long").alias("max_active"))


def mention_gaps(m: DataFrame) -> DataFrame:
    """``qid, n, mean_gap``: days between an id's successive mentions, their sum divided by the number of mentions."""
    w = Window.partitionBy("qid").orderBy("day")
    days = m.filter(F.col("qid").isNotNull() & F.col("day").isNotNull()).groupBy("qid", "day").agg(F.count("*").alias("n"))
    gaps = days.withColumn("gap", F.coalesce(F.datediff("day", F.lag("day").over(w)), F.lit(0)))
    return gaps.groupBy("qid").agg(F.sum("n").alias("n"), F.round(F.sum("gap") / F.sum("n"), 6).alias("mean_gap"))


def gap_summary(gaps: DataFrame) -> DataFrame:
    """One row over the ids: how many have one or several mentions; mean, population deviation and largest of the mean gaps."""
    many = F.when(F.col("n") > 1, F.col("mean_gap"))
    return gaps.agg(F.count_if(F.col("n") == 1).alias("single"), F.count_if(F.col("n") > 1).alias("multiple"), F.round(F.avg(many), 6).alias("mean_gap"), F.round(F.stddev_pop(many), 6).alias("std_gap"), F.round(F.max(many), 6).alias("max_gap"), F.round(F.median(many), 6).alias("median_gap"))


def chunks(rows: DataFrame, first: int, step: int) -> DataFrame:
    """``docno, pos, chunk``: the first ``first`` mentions are chunk 0, then ``step`` at a time."""
    place = F.row_number().over(Window.partitionBy("docno").orderBy("pos")) - 1
    return rows.select("docno", "pos", F.when(place < first, 0).otherwise(1 + F.floor((place - first) / step)).cast("int").alias("chunk"))


def slices(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """Rows of a group in slices of n: ``slice`` from 0."""
    return rows.withColumn("slice", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1) / n).cast("int"))


# statistics


def summary(documents: DataFrame, m: DataFrame) -> DataFrame:
    """One row: examples, mentions, outside mentions, distinct ids of both kinds, mentions per example."""
    docs = documents.agg(F.count("*").alias("n_examples"))
    s = m.agg(F.count("*").alias("n_mentions"), F.count_if("ookg").alias("n_ookg"), F.count_distinct("qid").alias("n_unique"), F.count_distinct(F.when(F.col("ookg"), F.col("qid"))).alias("n_unique_ookg"))
    return docs.crossJoin(s).select("*", F.round(F.try_divide("n_mentions", "n_examples"), 6).alias("mentions_per_example"))


def cluster_histogram(m: DataFrame) -> DataFrame:
    """``bucket, n, percent`` of the ids by their number of mentions: 1 to 5, 6-10, 11-20, 21-50, 51+."""
    sizes = m.filter(F.col("qid").isNotNull()).groupBy("qid").agg(F.count("*").alias("size"))
    s = F.col("size")
    bucket = F.when(s <= 5, s.cast("string")).when(s <= 10, "6-10").when(s <= 20, "11-20").when(s <= 50, "21-50").otherwise("51+")
    counts = sizes.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("bucket", "n", F.round(100 * F.col("n") / F.col("total"), 6).alias("percent"))


def ambiguity(m: DataFrame) -> DataFrame:
    """One row: mean and median number of ids per mention, and of mentions per id; outside ids apart."""

    def side(a: str, b: str, rows: DataFrame, name: str) -> DataFrame:
        n = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a).agg(F.count_distinct(b).alias("n"))
        return n.agg(F.round(F.avg("n"), 6).alias(f"mean_{name}"), F.median("n").alias(f"median_{name}"))

    low = m.withColumn("surface", F.lower("mention"))
    return side("surface", "qid", low, "ids_per_mention").crossJoin(side("qid", "surface", low, "mentions_per_id")).crossJoin(side("surface", "qid", low.filter("ookg"), "ookg_ids_per_mention"))


def overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: distinct keys of both sides, those in common, and the shares of either side that are in common."""
    one = a.select(*keys).dropna().distinct().withColumn("in_a", F.lit(1))
    two = b.select(*keys).dropna().distinct().withColumn("in_b", F.lit(1))
    s = one.join(two, keys, "full").agg(F.count("in_a").alias("n_a"), F.count("in_b").alias("n_b"), F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("n_both"))
    return s.select("*", F.round(F.try_divide("n_both", "n_a"), 6).alias("share_a"), F.round(F.try_divide("n_both", "n_b"), 6).alias("share_b"))


# token streams


def segments(lines: DataFrame, marker: str, per_file: str = "file") -> DataFrame:
    """``doc_no`` of every line: how many lines so far begin with the marker, by ``line_no`` within a file."""
    starts = F.when(F.col("line").startswith(marker), 1).otherwise(0)
    return lines.withColumn("doc_no", F.sum(starts).over(Window.partitionBy(per_file).orderBy("line_no")))


def iob_spans(tokens: DataFrame) -> DataFrame:
    """``doc_no, start, len, mention`` of marked spans in ``doc_no, line_no, token, tag``: B begins a span, I extends it.

    A token is followed by one blank; a null or empty tag, or a blank line (null token), ends a span.
    """
    w = Window.partitionBy("doc_no").orderBy("line_no")
    size = F.coalesce(F.length("token") + 1, F.lit(0))
    rows = tokens.withColumn("start", F.sum(size).over(w) - size)
    inside = F.col("tag").isin("B", "I") & F.col("token").isNotNull()
    opens = F.when((F.col("tag") == "B") | ~F.coalesce(inside, F.lit(False)), 1).otherwise(0)
    rows = rows.withColumn("span", F.sum(opens).over(w)).filter(inside)
    got = rows.groupBy("doc_no", "span").agg(F.min("start").alias("start"), F.max(F.col("start") + F.length("token")).alias("stop"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "token"))), lambda t: t["token"]), " ").alias("mention"))
    return got.select("doc_no", F.col("start").cast("long").alias("start"), (F.col("stop") - F.col("start")).cast("long").alias("len"), "mention")


def token_windows(tokens_per_mention: DataFrame, size: int) -> DataFrame:
    """Greedy windows of at most ``size`` tokens that never split a mention: ``docno, pos, window``.

    ``docno, pos, tok_start, tok_end`` (end exclusive). A window begins with a mention and takes all that end within it; the
    next one begins with the first mention that doesn't fit. Each begin depends on the one before, hence one grouped
    function per document (its mentions only, never its text).
    """

    def run(docno, rows):  # noqa: ANN001, ANN202
        window, begin, out = -1, None, []
        for _, pos, start, end in rows:
            if begin is None or end - begin > size:
                window, begin = window + 1, start
            out.append((docno, pos, window))
        return out

    rows = tokens_per_mention.select("docno", "pos", "tok_start", "tok_end")
    return each_group(rows, "docno", ["pos"], run, "docno long, pos int, window int")


# training material


def sampled_negatives(m: DataFrame, pool: DataFrame, k: int, seed: str = "7") -> DataFrame:
    """``docno, pos, negative, place``: k ids of a fixed random order that are neither the mention's nor another of its document.

    The pool (``id``) is cut into as many slots as there are ids in it, and a mention draws consecutive slots from a random
    one on; what is taboo is taken off afterwards, so that no mention meets the whole pool. Hence some mentions get fewer.
    """
    from pyspark.sql import Window as W

    parts = pool.select("id").distinct().withColumn("r", shuffled(seed, F.col("id"))).withColumn("part", F.conv(F.substring("r", 1, 3), 16, 10).cast("int"))
    placed = parts.withColumn("slot", F.row_number().over(W.partitionBy("part").orderBy("r", "id")))
    draw = F.pmod(F.xxhash64(F.lit(seed), "docno", "pos"), F.lit(4096)).cast("int")
    asked = m.filter(F.col("qid").isNotNull()).select("docno", "pos", "qid", F.explode(F.transform(F.sequence(F.lit(0), F.lit(2 * k)), lambda i: F.pmod(draw + i, F.lit(4096)))).alias("part"))
    drawn = asked.join(placed.filter("slot = 1").select("part", F.col("id").alias("negative"), "r"), "part")
    taboo = m.select("docno", F.col("qid").alias("negative")).filter(F.col("negative").isNotNull()).distinct()
    fair = drawn.join(taboo, ["docno", "negative"], "left_anti")
    order = W.partitionBy("docno", "pos").orderBy("r", "negative")
    return fair.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select("docno", "pos", "negative", "place")


def random_marks(m: DataFrame, p: float, seed: str = "7") -> DataFrame:
    """Mentions with a fixed share of the in-graph ones marked as outside, by their random numbers."""
    number = F.conv(F.substring(shuffled(seed, F.concat_ws(":", "docno", "pos")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return m.withColumn("ookg", F.col("ookg") | (number < p))


def free_occurrences(documents: DataFrame, m: DataFrame) -> DataFrame:
    """``docno, mention, start``: further occurrences (in any case) of a document's mentions that overlap none of its spans."""
    from tesserakg.functions.text import occurrences
    from tesserakg.runtime import ship

    ship(m.sparkSession)
    names = m.filter(F.col("mention") != "").select("docno", "mention").distinct()
    found = names.join(documents.filter(F.col("text").isNotNull()).select("docno", "text"), "docno").select("docno", "mention", F.explode(occurrences(F.col("text"), F.col("mention"))).alias("start"))
    spans = m.select("docno", F.col("start").alias("s"), (F.col("start") + F.col("len")).alias("e")).filter("s is not null and e is not null")
    hit = (found["docno"] == spans["docno"]) & (F.col("start") < F.col("e")) & (F.col("start") + F.length("mention") > F.col("s"))
    return found.join(spans, hit, "left_anti").select("docno", "mention", "start")
