"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs (lines, long ones cut every ``RUN`` words) are hashed to
64-bit digests. A sketch has three sub-tables; every digest falls into one
cell of each, and a cell keeps the count, the xor of the digests and the xor
of their check hashes. Subtracting the sketches of two versions cancels what
they share, and peeling recovers the digests in which they differ: a cell
that holds a single digest (count 1 or -1, check hash right) gives it away,
and taking it out of its other cells may free the next ones. Pairs that do
not peel empty are sketched again with four times the cells, until all do.

The published fingerprint is a sketch with a power of two of cells a
sub-table, at least as many as the text has digests, and more where it does
not peel empty by itself. A sketch folds to any smaller power of two (a
digest's cell is a hash modulo the cells), so two fingerprints fold to the
smaller one's cells, subtract and peel; where that fails, each is peeled by
itself and sketched again larger. The likenesses are thus those of the
published fingerprints, whatever the texts' sizes and differences; the query
takes the same sketches from the digests at hand instead of reading the
strings again.

The sketches are rows (pair, cell). Everything up to the recovered digests
is grouped by the pair, so after one exchange of the digest arrays all
subtracting and peeling stays inside the partitions.

Defined cases: null texts count as empty; empty texts have no digests and a
fingerprint that lists no cell, and two of them are alike (1.0); a paragraph that
repeats in a text counts once; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waypoint.llm.common import is_empty, table, text_or_empty
from waypoint.session import materialize

#: Words after which a long line is cut.
RUN = 16
#: Cells of each of the three sub-tables, powers of two: of the smallest published fingerprint, and of the first try.
PUBLISHED, FIRST = 4, 64
#: Times that a published fingerprint may double until it peels by itself.
DOUBLINGS = 24
#: Passes over the three sub-tables before a pair is tried again with more cells.
SWEEPS = 2


def digests(text: Column) -> Column:
    """Distinct 64-bit digests of the paragraphs."""
    runs = F.regexp_extract_all(text, F.lit(r"[^ \n]+(?: +[^ \n]+){0,%d}" % (RUN - 1)), F.lit(0))
    return F.array_distinct(F.transform(runs, lambda r: F.xxhash64(r)))


def _cell(digest: Column, sub: int, cells: int | Column) -> Column:
    """The digest's cell in sub-table ``sub`` of ``cells`` (a power of two) cells."""
    m = F.lit(cells) if isinstance(cells, int) else cells
    return (F.pmod(F.xxhash64(digest, F.lit(sub)), m) + F.lit(sub) * m).cast("int")


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(-1))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _not_alone(keys: Column, sub: int, cells: Column) -> Column:
    """The digests that share their cell of sub-table ``sub``: what one pass of peeling leaves."""
    spots = F.sort_array(F.transform(keys, lambda k: F.struct(_cell(k, sub, cells).alias("c"), k.alias("k"))))
    return _let(spots, lambda s: F.transform(
        F.filter(s, lambda x, i: (F.get(s, i - 1)["c"] == x["c"]) | (F.get(s, i + 1)["c"] == x["c"])),
        lambda x: x["k"]))


def published_cells(keys: Column) -> Column:
    """Cells a sub-table of the published sketch: the first power of two, not below the number of
    digests, at which the sketch peels empty by itself."""
    start = F.greatest(F.lit(PUBLISHED).cast("long"),
                       F.pow(F.lit(2.0), F.length(F.bin(F.greatest(F.size(keys), F.lit(1)) - 1))).cast("long"))

    def step(s: Column, _: Column) -> Column:
        left = keys
        for _ in range(SWEEPS):
            for sub in range(3):
                left = _not_alone(left, sub, s["m"])
        retried = _let(F.size(left) == 0, lambda ok: F.struct(
            F.when(ok, s["m"]).otherwise(s["m"] * 2).alias("m"), ok.alias("ok")))
        return F.when(s["ok"], s).otherwise(retried)

    return F.aggregate(F.sequence(F.lit(1), F.lit(DOUBLINGS)),
                       F.struct(start.alias("m"), F.lit(False).alias("ok")), step, lambda s: s["m"])


def fingerprint(keys: Column) -> Column:
    """The published sketch of an array of distinct digests as text: 8 hex digits of the cells a sub-table, then
    the cells in use in order, each as its number and count (8 digits each), the xor of its digests and
    the xor of their check hashes (16 each)."""
    hexed = lambda x, digits: F.lpad(F.lower(F.hex(x)), digits, "0")
    xor = lambda xs, of: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(of(x["k"])))

    def listed(m: Column) -> Column:
        spots = F.sort_array(F.flatten(F.transform(keys, lambda k: F.array(*[
            F.struct(_cell(k, sub, m).alias("c"), k.alias("k")) for sub in range(3)]))))
        first = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (
            i == 0) | (F.get(s, i - 1)["c"] != F.get(s, i)["c"]))
        cell = lambda own: F.concat(
            hexed(own[0]["c"], 8), hexed(F.size(own), 8), hexed(xor(own, lambda k: k), 16), hexed(xor(own, _check), 16))
        cells = lambda s: _let(first(s), lambda f: F.array_join(F.transform(f, lambda i, j: _let(
            F.slice(s, i + 1, F.coalesce(F.get(f, j + 1), F.size(s)) - i), cell)), ""))
        return F.concat(hexed(m, 8), F.when(F.size(keys) == 0, "").otherwise(_let(spots, cells)))

    return _let(published_cells(keys), listed)


def _subtracted(pairs: DataFrame, ids: list[str], cells: int) -> DataFrame:
    """Non-zero cells of the difference of the sketches of ``a`` and ``b``: (ids, cell, n, key, chk)."""
    signed = lambda name, sign: F.transform(F.col(name), lambda k: F.struct(
        k.alias("key"), F.lit(sign).alias("n")))
    rows = (pairs.select(*ids, F.explode(F.concat(signed("a", 1), signed("b", -1))).alias("x"))
            .select(*ids, F.col("x.key").alias("key"), F.col("x.n").alias("n"))
            .select(*ids, "key", "n", F.explode(F.array(*[_cell(F.col("key"), s, cells) for s in range(3)])).alias("cell")))
    return (rows.groupBy(*ids, "cell")
            .agg(F.sum("n").cast("int").alias("n"), F.bit_xor("key").alias("key"),
                 F.bit_xor(_check(F.col("key"))).alias("chk"))
            .where("n <> 0 OR key <> 0 OR chk <> 0")
            .withColumn("out", F.lit(None).cast("long")))


def _peeled(cells_: DataFrame, ids: list[str], sub: int, cells: int) -> DataFrame:
    """One pass over sub-table ``sub``: its single digests leave the other sub-tables.

    A digest has one cell in a sub-table, so a pass meets it once. Recovered
    digests are rows with ``out`` set and their side in ``n``."""
    key = F.col("key")
    single = (F.col("out").isNull() & F.col("cell").between(sub * cells, (sub + 1) * cells - 1)
              & (F.abs("n") == 1) & (F.col("chk") == _check(key)) & (_cell(key, sub, cells) == F.col("cell")))
    row = lambda cell, n, k, c, out: F.struct(
        cell.alias("cell"), n.alias("n"), k.alias("key"), c.alias("chk"), out.alias("out"))
    none = F.lit(None).cast("long")
    others = [row(_cell(key, s, cells), -F.col("n"), key, F.col("chk"), none) for s in range(3) if s != sub]
    given = row(F.lit(-1), F.col("n"), F.lit(0).cast("long"), F.lit(0).cast("long"), key)
    same = row(F.col("cell"), F.col("n"), key, F.col("chk"), F.col("out"))
    return (cells_.select(*ids, F.explode(F.when(single, F.array(*others, given)).otherwise(F.array(same))).alias("r"))
            .select(*ids, "r.*")
            .groupBy(*ids, "cell", "out")
            .agg(F.sum("n").cast("int").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("chk").alias("chk"))
            .where("n <> 0 OR key <> 0 OR chk <> 0"))


def differences(pairs: DataFrame, ids: list[str], first: int = FIRST) -> DataFrame:
    """Digests in which ``a`` and ``b`` (arrays of distinct digests) differ:
    ids, only_a and only_b (arrays). Pairs without a difference are not listed.

    ``ids`` must name a row of ``pairs``.
    """
    found, cells, todo = None, first, pairs
    while True:
        state = _subtracted(todo.repartition(*ids), ids, cells)
        for _ in range(SWEEPS):
            for sub in range(3):
                state = _peeled(state, ids, sub, cells)
        done = materialize(
            state.groupBy(*ids).agg(
                F.count_if(F.col("out").isNull()).alias("left"),
                F.collect_list(F.when(F.col("n") > 0, F.col("out"))).alias("only_a"),
                F.collect_list(F.when(F.col("n") < 0, F.col("out"))).alias("only_b")), "peeled")
        good = done.where("left = 0").drop("left")
        found = good if found is None else found.unionByName(good)
        again = done.where("left > 0").select(*ids)
        if is_empty(again):
            return found
        todo, cells = pairs.join(again, ids, "left_semi"), cells * 4


def likeness(n_a: Column, n_b: Column, n_diff: Column) -> Column:
    """Shared digests to all digests of two sets, from their sizes and that of their difference."""
    return F.when(n_a + n_b + n_diff == 0, 1.0).otherwise((n_a + n_b - n_diff) / (n_a + n_b + n_diff))


def _descending_buckets(ids: DataFrame, buckets: int) -> tuple[list, list]:
    """Bounds that split the ids into runs of like size, and the first (largest) id of each run.

    At most ``buckets`` numbers of each reach the driver.
    """
    cuts = ids.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 10_000)).first()[0]
    bounds = sorted(set(cuts or []), reverse=True)
    heads = {r[0]: r[1] for r in ids.groupBy(_bucket(bounds).alias("b")).agg(F.max("doc_id")).collect()}
    return bounds, [heads.get(b) for b in range(len(bounds) + 1)]


def _bucket(bounds: list) -> Column:
    """How many bounds are above the id (all, for a null id): coarse bounds first, then one run of them."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    above = lambda b: F.coalesce(b > F.col("doc_id"), F.lit(True))
    coarse = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in bounds[step - 1::step]]), above)) * step
    rest = F.slice(F.array(*[F.lit(x).cast("long") for x in bounds]), coarse + 1, step)
    return coarse + F.size(F.filter(rest, above))


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """``docs`` (doc_id, text) with bucket, place (unique in a bucket), keys, next_text and next_keys.

    The next document has the next smaller id (nulls last, then by text
    hash); the last one's is the first. Ids are cut into ``buckets`` runs, and
    the head of a run is copied to the end of the one before, so texts cross
    the network once and no task holds more than a run.
    """
    bounds, heads = _descending_buckets(docs.select("doc_id"), buckets)
    used = [b for b, h in enumerate(heads) if h is not None]
    # null ids live in the last run even if it has no other
    last = len(heads) - 1 if not used or docs.where("doc_id IS NULL").limit(1).count() else used[-1]
    before = {b: p for p, b in zip(used, used[1:])}
    head_of = F.array(*[F.lit(h).cast("long") for h in heads])
    to = F.array(*[F.lit(before.get(b)).cast("int") for b in range(len(heads))])
    b = _bucket(bounds)
    spot = lambda bucket, copy, wrap: F.struct(
        bucket.alias("bucket"), F.lit(copy).alias("copy"), F.lit(wrap).alias("wrap"))
    is_head = F.get(head_of, b) == F.col("doc_id")
    first = heads[used[0]] if used else None
    is_first = F.col("doc_id") == F.lit(first).cast("long") if used else F.col("doc_id").isNull()
    # the run before an empty tail of nulls: nulls follow the last id
    tail = used and last != used[-1]
    spots = F.filter(F.array(
        spot(b, 0, 0), F.when(is_head & F.get(to, b).isNotNull(), spot(F.get(to, b), 1, 0)),
        F.when(is_first, spot(F.lit(last), 1, 1)),
        *([F.when(F.col("doc_id").isNull(), spot(F.lit(used[-1]), 1, 0))] if tail else [])),
        lambda s: s.isNotNull())
    order = Window.partitionBy("bucket").orderBy("wrap", F.col("doc_id").desc_nulls_last(), "mark")
    return (docs.select("doc_id", text_or_empty().alias("text"))
            .select("*", digests(F.col("text")).alias("keys"), F.xxhash64("text").alias("mark"),
                    F.explode(spots).alias("s"))
            .select("doc_id", "text", "keys", "mark", "s.*")
            .withColumn("next_text", F.lead("text").over(order))
            .withColumn("next_keys", F.lead("keys").over(order))
            .withColumn("place", F.row_number().over(order))
            .where("copy = 0").drop("copy", "wrap", "mark"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    buckets = 4 * max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half),
                      F.substring(F.col("next_text"), F.lit(1), half))
    rows = (with_next(docs, buckets)
            .select("bucket", "place", "doc_id", n.cast("long").alias("n_chars"), "keys", "next_keys",
                    edited.alias("edited"))
            .withColumn("edited_sha256", F.sha2("edited", 256))
            .withColumn("edited_keys", digests(F.col("edited"))).drop("edited"))
    rows = materialize(rows, "digests")
    pairs = (rows.select("bucket", "place", F.col("keys").alias("a"),
                         F.explode(F.array(F.struct(F.lit(0).alias("pair"), F.col("edited_keys").alias("b")),
                                           F.struct(F.lit(1).alias("pair"), F.col("next_keys").alias("b")))).alias("p"))
             .select("bucket", "place", "p.pair", "a", "p.b"))
    diff = (differences(pairs, ["bucket", "place", "pair"])
            .groupBy("bucket", "place")
            .agg(*[F.max(F.when(F.col("pair") == i, F.size("only_a") + F.size("only_b"))).alias(f"d{i}")
                   for i in range(2)]))
    size = lambda c: F.size(c).cast("double")
    d = lambda i: F.coalesce(F.col(f"d{i}"), F.lit(0))
    return (rows.join(diff, ["bucket", "place"], "left").select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("keys")).alias("fingerprint"),
        fingerprint(F.col("edited_keys")).alias("edited_fingerprint"),
        likeness(size("keys"), size("edited_keys"), d(0)).alias("near_edited"),
        likeness(size("keys"), size("next_keys"), d(1)).alias("near_next")))
