"""Near-duplicate groups by bottom-k sketches of word shingles.

A document's set is its distinct word shingles, hashed by one function; its
sketch is the ``SKETCH`` smallest hashes. Documents with equal sets are one
class from here on. Then:

* Inverted lists. A key is a run of three neighbouring retained values. Sets
  with a similarity of 0.8 miss at most one value in five, so that some run
  survives: in whole sets always (at most a fifth of the union is not shared,
  so the rest has runs of four on average; four shared values of five alone may
  be parted two and two), and in sketches of 64 but for about one pair in 10^9. A run is rarer than a value: one very common shingle, or
  a passage that many documents share, makes no long list. Sets of up to five
  shingles, where runs may break, use single values; sets of five use both, so
  that they meet smaller and larger ones.
* Stars. Each member of a list is compared with the list's first member: the
  union sketch estimates the similarity, the full sets confirm it. Confirmed
  links give components.
* The rest. Members of one list that are not in one component by then are
  compared, long lists in pairs of blocks; a pair counts in the first of its
  lists only, and only pairs that the union sketch allows leave the task, to be
  confirmed in the same way. Pairs within a component are not compared: a large
  group of copies costs a star, and yet no link between groups is lost.

A sketch holds the upper halves of the hashes. The estimate discards what lies
more than six standard deviations under the asked similarity.

Defined results: null texts and texts without words have an empty set and link
with nothing; texts of fewer words than a shingle have one shingle, all words;
rows with one id are separate members that share the id; null ids never name a
component unless all members' ids are null; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobreview.llm.common import ascii_lower, words, written
from jobreview.llm.components import components
from jobreview.llm.sketch_pairs import RUN, RUN_SET, RUN_SKETCH, SKETCH, SMALL_SET, compared
from jobreview.operators.keyfilter import key_filter, may_hold

BLOCK = 512
# The largest filter of keys, for eight million lists.
MAX_FILTER_WORDS = 1 << 21


def shingle_set(text: Column, n_words: int) -> Column:
    """Sorted distinct hashes of the shingles of ``n_words`` words."""
    hashes = F.transform(words(ascii_lower(text)), lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        last = F.size(h) - n_words
        runs = F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(n_words)]),
        )
        whole = F.array(F.xxhash64(F.lit("short"), h))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(last < 0, whole).otherwise(runs)

    # A one-element transform evaluates the hashes once.
    sets = F.transform(F.array(hashes), lambda h: F.sort_array(F.array_distinct(shingles(h))))
    return F.get(sets, F.lit(0))


def described(docs: DataFrame, n_words: int) -> DataFrame:
    """(doc, text_hash, n, node, sketch) of each row of ``docs`` (doc, text).
    ``node`` names the set by two hashes."""
    rows = docs.select("doc", F.xxhash64("text").alias("text_hash"), F.explode(F.array(shingle_set(F.col("text"), n_words))).alias("s"))
    return rows.select(
        "doc",
        "text_hash",
        F.size("s").cast("long").alias("n"),
        F.when(F.size("s") > 0, F.struct(F.xxhash64("s").alias("a"), F.xxhash64(F.lit(1), "s").alias("b"))).alias("node"),
        F.transform(F.slice("s", 1, SKETCH), lambda h: F.shiftright(h, 32).cast("int")).alias("sketch"),
    )


def _keys(classes: DataFrame) -> DataFrame:
    """(key, at, node, n): the lists each class is in; ``at`` is the value that
    the key begins with."""
    n = F.least(F.size("sketch"), F.lit(RUN_SKETCH))

    def steps(width: int) -> Column:
        return F.transform(F.sequence(F.lit(0), n - width), lambda i: F.struct(F.lit(width).alias("width"), i.alias("i")))

    # Sets of four and five can be alike without a common run, sets of five and
    # more always have one with larger sets: sets of five are in both lists.
    single = F.when(F.col("n") <= SMALL_SET, steps(1)).otherwise(F.array().cast("array<struct<width:int,i:int>>"))
    both = F.when(F.col("n") >= RUN_SET, F.concat(single, steps(RUN))).otherwise(single)
    rows = classes.select("node", "n", "sketch", F.explode(both).alias("step")).select("node", "n", "sketch", "step.*")
    at = F.get("sketch", F.col("i"))
    run = F.xxhash64(F.lit(RUN), *[F.get("sketch", F.col("i") + j) for j in range(RUN)])
    key = F.when(F.col("width") == 1, F.xxhash64(F.lit(1), at)).otherwise(run)
    return rows.select(key.alias("key"), at.alias("at"), "node", "n")


def _members(keys: DataFrame) -> DataFrame:
    """(key, at, node, n, first) of the lists with several nodes, stored. Most keys
    occur once: they are counted alone, and go before whole rows are shuffled."""
    often = written(keys.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key"), "sketch-often")
    kept = key_filter(often, ["key"], often.count(), MAX_FILTER_WORDS)
    likely = keys if kept is None else may_hold(keys, ["key"], kept)
    listed = written(likely.join(often.hint("merge"), "key"), "sketch-listed")
    lists = listed.groupBy("key").agg(F.min(F.struct("node", "n")).alias("first"), F.max("node").alias("last"))
    lists = lists.filter("first.node != last").select("key", "first")
    return written(listed.join(lists, "key").select("key", "at", "node", "n", "first"), "sketch-lists")


def _fits(n_a: Column, n_b: Column, percent: int) -> Column:
    """Sizes that allow the similarity."""
    return F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent


def _estimate(a: Column, b: Column) -> Column:
    """Share of the union's sketch that both sketches hold; of the whole union
    where no sketch is full."""
    union = F.sort_array(F.array_union(a, b))
    whole = (F.size(a) < SKETCH) & (F.size(b) < SKETCH)
    union = F.when(whole, union).otherwise(F.slice(union, 1, SKETCH))
    return F.size(F.array_intersect(F.array_intersect(union, a), b)) / F.size(union)


def _least(n_a: Column, n_b: Column, percent: int) -> Column:
    """The estimate below which the similarity is out of the question. Drawing
    without return narrows it for sets not much larger than a sketch, and next
    to nothing is left for whole sets."""
    share = percent / 100
    drawn = F.greatest(1 - SKETCH / (n_a + n_b), F.lit(0.0))
    drawn = F.when(F.greatest(n_a, n_b) < SKETCH, F.lit(0.0)).otherwise(drawn)
    return share - 6 * F.sqrt(share * (1 - share) / SKETCH * drawn) - 0.005


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose union sketch allows the similarity, with the estimate."""
    a, b = (
        classes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab"
    )
    rows = pairs.join(a, "a").join(b, "b").withColumn("estimate", _estimate(F.col("sketch_a"), F.col("sketch_b")))
    return rows.filter(F.col("estimate") >= _least(F.col("n_a"), F.col("n_b"), percent)).select("a", "b", "estimate")


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n_words: int, percent: int) -> DataFrame:
    """The pairs whose full sets are alike. Sets are made anew from one text
    of each class that a pair names; most other texts stay where they are."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = classes.join(named, "node").select("node", F.col("doc").alias("rep"), F.col("text_hash").alias("rep_hash"))
    texts = written(texts, "sketch-texts")
    hashed = F.xxhash64("rep", "rep_hash").alias("rep_key")  # never null
    kept = key_filter(texts.select(hashed), ["rep_key"], texts.count(), MAX_FILTER_WORDS)
    if kept is not None:
        docs = docs.select("doc", "text", F.xxhash64("doc", F.xxhash64("text")).alias("rep_key"))
        docs = may_hold(docs, ["rep_key"], kept)
    same = docs["doc"].eqNullSafe(texts["rep"]) & (F.xxhash64(docs["text"]) == texts["rep_hash"])
    sets = docs.join(texts, same).select("node", "text").dropDuplicates(["node"])
    sets = written(sets.select("node", shingle_set(F.col("text"), n_words).alias("s")), "shingle-sets")
    a = sets.select(F.col("node").alias("a"), F.col("s").alias("s_a"))
    b = sets.select(F.col("node").alias("b"), F.col("s").alias("s_b"))
    both = F.size(F.array_intersect("s_a", "s_b"))
    rows = pairs.join(a, "a").join(b, "b").select("a", "b", both.alias("both"), (F.size("s_a") + F.size("s_b")).alias("sum"))
    return rows.filter(F.col("both") * 100 >= (F.col("sum") - F.col("both")) * percent).select("a", "b")


def _rooted(nodes: DataFrame, roots: DataFrame, name: str, out: str) -> DataFrame:
    """``nodes`` with the component of the column ``name``; itself if it has no link."""
    found = roots.select(F.col("node").alias(name), F.col("root").alias(out))
    return nodes.join(found, name, "left").withColumn(out, F.coalesce(out, name))


def near_groups(docs: DataFrame, n_words: int = 5, percent: int = 80) -> DataFrame:
    """(doc, text_hash, n, component) of each row of ``docs`` (doc, text):
    ``component`` is the smallest id of its group."""
    rows = written(described(docs, n_words), "sketches")
    classes = written(
        rows.filter("n > 0")
        .groupBy("node")
        .agg(F.min(F.struct(F.col("doc").isNull().alias("absent"), "doc", "text_hash", "n", "sketch")).alias("c"))
        .select("node", "c.doc", "c.text_hash", "c.n", "c.sketch"),
        "sketch-classes",
    )
    members = _members(written(_keys(classes), "sketch-keys"))
    stars = (
        members.filter((F.col("node") != F.col("first.node")) & _fits(F.col("n"), F.col("first.n"), percent))
        .select(F.col("node").alias("a"), F.col("first.node").alias("b"))
        .distinct()
    )
    stars = written(_estimated(stars, classes, percent), "sketch-stars")
    best = Window.partitionBy("a").orderBy(F.col("estimate").desc(), "b")
    likeliest = stars.withColumn("r", F.row_number().over(best)).filter("r = 1").select("a", "b")
    links = written(_confirmed(likeliest, classes, docs, n_words, percent), "sketch-links")
    roots = components(links)
    # What the likeliest links leave apart: the other stars, then the other pairs.
    for more in ("stars", "pairs"):
        if more == "stars":
            rest = _rooted(_rooted(stars.select("a", "b"), roots, "a", "root_a"), roots, "b", "root_b")
            rest = rest.filter("root_a != root_b").select("a", "b")
        else:
            rest = _across(members, roots, classes, percent)
        rest = written(rest, "sketch-rest")
        if rest.limit(1).count():
            links = links.unionByName(_confirmed(rest, classes, docs, n_words, percent))
            links = written(links, "sketch-links")
            roots = components(links)
    named = _rooted(classes.select("node", "doc"), roots, "node", "root")
    smallest = named.groupBy("root").agg(F.min("doc").alias("component"))
    names = named.select("node", "root").join(smallest, "root").select("node", "component")
    grouped = rows.join(names, "node", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc"))
    return grouped.select("doc", "text_hash", "n", component.alias("component"))


def _across(members: DataFrame, roots: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of one list and different components that the union sketch allows."""
    rooted = _rooted(members.select("key", "at", "node", "n"), roots, "node", "root")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("m"))
    mixed = mixed.filter("x != y").select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    rooted = rooted.join(mixed, "key").join(classes.select("node", "sketch"), "node")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = rooted.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "at", "n",
        F.col("node.a").alias("a"), F.col("node.b").alias("b"), F.xxhash64("root").alias("root"), "sketch",
    )
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "a", "b")
    schema = "a_a long, a_b long, b_a long, b_b long"
    found = rows.mapInArrow(lambda batches: compared(batches, percent), schema).distinct()
    node = [F.struct(F.col(f"{x}_a").alias("a"), F.col(f"{x}_b").alias("b")).alias(x) for x in "ab"]
    return found.select(*node)


def mark_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, percent: int = 80
) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every document."""
    slim = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    grouped = near_groups(slim, n_words, percent)
    return grouped.select(
        F.col("doc").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.col("doc").eqNullSafe(F.col("component")).alias("kept"),
    )


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, percent: int = 80
) -> DataFrame:
    """The documents that name their group, with all their columns."""
    slim = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    grouped = near_groups(slim, n_words, percent)
    gone = grouped.filter(~F.col("doc").eqNullSafe(F.col("component"))).select("doc", "text_hash").distinct()
    same = docs[id_col].eqNullSafe(gone["doc"]) & F.xxhash64(docs[text_col].cast("string")).eqNullSafe(gone["text_hash"])
    return docs.join(gone, same, "left_anti")


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 2 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""
