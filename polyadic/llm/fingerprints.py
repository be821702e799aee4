"""Document fingerprints by invertible Bloom lookup sketches, in DataFrame functions only.

A text is a set of paragraph digests.  Its sketch is a few tables of cells; each digest is XORed into
one cell of every table and counted there.  The sketches of two versions are subtracted cell by cell,
so that what they share cancels out, and cells that hold a single digest are peeled off one after
another until the differing digests are known.  Where peeling gets stuck, both sketches are made
again, larger and with other cells, until all are solved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyadic.tensor import positions

from .scratch import drop_scratch, write_scratch

#: A paragraph ends with its line, after the first sentence mark behind so many code points, or at the most.
LEAST_CHARS, MOST_CHARS = 64, 192
#: Tables of a fingerprint and their cells, a power of two.
TABLES, CELLS = 3, 8
#: Retries: digests of both texts for each part, and cells of its tables (a power of two).
PART_DIGESTS, PART_CELLS = 8, 16

_CHECK = 0xFFFF


def paragraphs(text: Column) -> Column:
    """The text cut into paragraphs, without leaving anything out."""
    return F.regexp_extract_all(text, F.lit(rf"[^\n]{{{LEAST_CHARS},{MOST_CHARS}}}?[.!?]++\n*+|[^\n]{{1,{MOST_CHARS}}}\n*+|\n++"), F.lit(0))


def _certified(h: Column) -> Column:
    """48 bits of a hash, followed by 16 bits that prove that they belong to one digest only."""
    high = h.bitwiseAND(~_CHECK)
    return high.bitwiseOR(F.xxhash64(high).bitwiseAND(_CHECK))


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs."""
    return F.array_distinct(F.transform(paragraphs(text), lambda p: _certified(F.xxhash64(p))))


def _is_digest(x: Column) -> Column:
    return F.xxhash64(x.bitwiseAND(~_CHECK)).bitwiseAND(_CHECK) == x.bitwiseAND(_CHECK)


def _place(h: Column, table: Column | int, cells: int) -> Column:
    """A digest's cell in a table: some bits of its hash."""
    bits = cells.bit_length() - 1
    shifted = F.shiftrightunsigned(h, table * bits) if isinstance(table, int) else F.call_function("shiftrightunsigned", h, (table * bits).cast("int"))
    return shifted.bitwiseAND(cells - 1).cast("int")


def _hash(x: Column, salt: Column | None) -> Column:
    """What places are taken from: the digest's upper bits, or with a salt another hash."""
    return F.shiftrightunsigned(x, 16) if salt is None else F.xxhash64(x, salt)


def sketch(found: Column) -> Column:
    """Cells (n, x) of a set of digests, table by table: how many are in the cell, and their XOR."""
    bits = CELLS.bit_length() - 1
    where = F.array(*(F.struct(F.lit((CELLS - 1) << (16 + t * bits)).cast("long").alias("mask"), F.lit(i << (16 + t * bits)).cast("long").alias("value")) for t in range(TABLES) for i in range(CELLS)))

    def cell(ks: Column) -> Column:
        return F.struct(F.size(ks).alias("n"), F.aggregate(ks, F.lit(0).cast("long"), lambda a, k: a.bitwiseXOR(k)).alias("x"))

    return F.transform(F.transform(where, lambda w: F.filter(found, lambda k: k.bitwiseAND(w["mask"]) == w["value"])), cell)


def as_text(cells: Column, many: Column) -> Column:
    """The fingerprint: the number of digests and every cell's count modulo 256 and XOR, in hexadecimal."""
    parts = F.transform(cells, lambda c: F.concat(F.lpad(F.hex(c["n"].bitwiseAND(255).cast("long")), 2, "0"), F.lpad(F.hex(c["x"]), 16, "0")))
    return F.lower(F.concat(F.lpad(F.hex(many.cast("long")), 8, "0"), F.array_join(parts, "")))


def subtracted(a: Column, b: Column) -> Column:
    """The cells of two sketches that differ, as (t, i, n, x)."""
    both = F.zip_with(a, b, lambda u, v: F.struct((u["n"] - v["n"]).alias("n"), u["x"].bitwiseXOR(v["x"]).alias("x")))
    both = F.transform(both, lambda c, at: F.struct(F.floor(at / CELLS).cast("int").alias("t"), (at % CELLS).cast("int").alias("i"), c["n"].alias("n"), c["x"].alias("x")))
    return F.filter(both, lambda c: (c["n"] != 0) | (c["x"] != 0))


def peeled(cells: Column, places: int, salt: Column | None = None) -> Column:
    """Of subtracted cells: solved (nothing is left), and how many digests only the first and only the second had.

    A round takes all digests that are alone in a cell out of the other cells.
    """

    def let(value: Column, body) -> Column:
        return F.transform(F.array(value), body)[0]

    def marked(c: Column) -> Column:
        alone = F.when((F.abs(c["n"]) == 1) & _is_digest(c["x"]), _hash(c["x"], salt))
        return F.struct(c["t"].alias("t"), c["i"].alias("i"), c["n"].alias("n"), c["x"].alias("x"), alone.alias("h"))

    def pure(c: Column) -> Column:
        return c["h"].isNotNull() & (_place(c["h"], c["t"], places) == c["i"])

    def without(c: Column, found: Column) -> Column:
        here = F.filter(found, lambda k: _place(k["h"], c["t"], places) == c["i"])
        return let(here, lambda ks: F.struct(c["t"].alias("t"), c["i"].alias("i"), F.aggregate(ks, c["n"], lambda a, k: a - k["n"]).alias("n"), F.aggregate(ks, c["x"], lambda a, k: a.bitwiseXOR(k["x"])).alias("x")))

    def after(state: Column, cells: Column, found: Column) -> Column:
        left = F.filter(F.transform(F.filter(cells, lambda c: ~F.coalesce(pure(c), F.lit(False))), lambda c: without(c, found)), lambda c: (c["n"] != 0) | (c["x"] != 0))
        lost = F.size(F.filter(found, lambda k: k["n"] == 1))
        return F.struct(left.alias("cells"), (state["lost"] + lost).alias("lost"), (state["gained"] + F.size(found) - lost).alias("gained"), ((F.size(found) > 0) & (F.size(left) > 0)).alias("more"))

    def step(state: Column, _: Column) -> Column:
        def onward(cells: Column) -> Column:
            return let(F.array_distinct(F.transform(F.filter(cells, pure), lambda c: F.struct(c["n"].alias("n"), c["x"].alias("x"), c["h"].alias("h")))), lambda found: after(state, cells, found))

        return F.when(state["more"], let(F.transform(state["cells"], marked), onward)).otherwise(state)

    def whole(cells: Column) -> Column:
        start = F.struct(cells.alias("cells"), F.lit(0).alias("lost"), F.lit(0).alias("gained"), (F.size(cells) > 0).alias("more"))
        return F.aggregate(cells, start, step, lambda s: F.struct((F.size(s["cells"]) == 0).alias("solved"), s["lost"].alias("lost"), s["gained"].alias("gained")))

    return let(cells, whole)


def _likeness(a: Column, b: Column, lost: Column, gained: Column) -> Column:
    """Shared digests over all digests; two texts without any are alike.  Counts that cannot be give null."""
    shared = a - lost
    union = b + lost
    return F.when((shared < 0) | (shared + gained != b), None).when(union == 0, 1.0).otherwise(shared / union)


def _larger(pairs: DataFrame, key: list[str], attempt: int) -> DataFrame:
    """(pair, near) for ``pairs`` (key, pair, near, a, b) with sketches of a size that fits both texts, doubled with each attempt.

    Digests go to parts by a hash, so that a part stays small however long a text is; a pair's parts
    are peeled one by one.  ``near`` is null where one of them gets stuck; where it is known already, it
    stays.  Frames that are dealt out by ``key``, which a pair determines, are not shuffled.
    """
    salt = F.lit(attempt)
    keys = F.concat(F.transform("a", lambda k: F.struct(k.alias("k"), F.lit(1).alias("n"))), F.transform("b", lambda k: F.struct(k.alias("k"), F.lit(-1).alias("n"))))
    parts = ((F.size("a") + F.size("b")) * 2**attempt / PART_DIGESTS + 1).cast("int")
    # The pair's numbers of digests ride on a cell of their own, -1.
    sizes = F.array(F.struct(F.size("a").cast("long").alias("k"), F.size("b").alias("n")))
    by = [*key, "pair", "near"]
    rows = pairs.select(*by, parts.alias("parts"), F.posexplode(F.when(F.col("near").isNull(), F.concat(sizes, keys)).otherwise(sizes)).alias("at", "e"))
    h = F.xxhash64("e.k", salt)
    slots = F.array(*(F.pmod(F.shiftrightunsigned(h, 16), F.col("parts")) * (TABLES * PART_CELLS) + t * PART_CELLS + _place(h, t, PART_CELLS) for t in range(TABLES)))
    rows = rows.select(*by, "e.k", "e.n", F.explode(F.when(F.col("at") == 0, F.array(F.lit(-1).cast("long"))).otherwise(slots)).alias("slot"))
    cells = rows.groupBy(*by, "slot").agg(F.sum("n").cast("int").alias("n"), F.bit_xor("k").alias("x")).where("slot < 0 or n <> 0 or x <> 0")
    inside = F.pmod(F.col("slot"), F.lit(TABLES * PART_CELLS)).cast("int")
    cell = F.struct(F.floor(inside / PART_CELLS).cast("int").alias("t"), (inside % PART_CELLS).alias("i"), "n", "x")
    some = cells.groupBy(*by, F.floor(F.col("slot") / (TABLES * PART_CELLS)).alias("part")).agg(F.collect_list(cell).alias("cells"))
    own = F.col("part") >= 0
    some = some.withColumn("p", F.when(own, peeled(F.col("cells"), PART_CELLS, salt)))
    known = F.when(~own, F.col("cells")[0])
    whole = some.groupBy(*by).agg(F.max(known["x"]).alias("na"), F.max(known["n"]).alias("nb"), F.coalesce(F.bool_and("p.solved"), F.lit(True)).alias("solved"), F.coalesce(F.sum("p.lost"), F.lit(0)).alias("lost"), F.coalesce(F.sum("p.gained"), F.lit(0)).alias("gained"))
    return whole.select("pair", F.coalesce("near", F.when(F.col("solved"), _likeness(F.col("na"), F.col("nb"), F.col("lost"), F.col("gained")))).alias("near"))


def _first_try(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    """The likeness from two fingerprints, or null where peeling gets stuck."""
    p = F.transform(F.array(peeled(subtracted(cells_a, cells_b), CELLS)), lambda p: F.when(p["solved"], _likeness(F.size(a), F.size(b), p["lost"], p["gained"])))
    return p[0]


def _neighbours(rows: DataFrame) -> DataFrame:
    """(id, h, copies, nid, nh, pid, ph, pk): each distinct row's next and previous one in a ring, and what the previous one takes.

    Places come from a range sort of short rows; no task sees all.
    """
    short = write_scratch(rows.groupBy("id", "h", "n").agg(F.count("*").alias("copies")), "short")
    at = write_scratch(positions(short.select(F.struct("id", "h").alias("key")), "key", "at").select("key.id", "key.h", "at").join(short, ["id", "h"]), "places")
    drop_scratch(short)
    total = at.count()
    left = at.select("id", "h", "copies", F.pmod(F.col("at") + 1, F.lit(max(total, 1))).alias("next"), F.pmod(F.col("at") - 1, F.lit(max(total, 1))).alias("before"))
    after = at.select(F.col("at").alias("next"), F.col("id").alias("nid"), F.col("h").alias("nh"))
    ahead = at.select(F.col("at").alias("before"), F.col("id").alias("pid"), F.col("h").alias("ph"), F.floor(F.col("n") / 4).cast("int").alias("pk"))
    out = write_scratch(left.join(after, "next").join(ahead, "before").drop("next", "before"), "ring")
    drop_scratch(at)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last quarter (rounded down) of its code points replaced by as many first
    ones of the next document by ascending identifier, or all if it has fewer; the first document
    follows the last.  Null texts count as empty.  A null identifier (or -2^63, which counts as null) comes first; rows that repeat an
    identifier are ordered by a hash of their texts, and equal rows follow one another.  A single row
    is its own next one.  Fingerprints are equal for equal texts, have one size for texts of any
    length, and hold the number of paragraph digests and the cells of their sketch.  Likenesses are
    shared over all distinct digests of two texts (two empty ones: 1): from the two fingerprints where
    their difference can be peeled, else from larger sketches of the same digests.  No text and no
    table is too long; an empty table gives no rows.  Columns other than the two named are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.lit(-(2**63))  # stands for null identifiers
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), none).alias("id"), text.alias("text")).select("id", F.xxhash64("text").alias("h"), "text")
    ring = _neighbours(rows.select("id", "h", F.char_length("text").alias("n")))
    once = rows.dropDuplicates(["id", "h"])
    here = once.join(ring, ["id", "h"])
    heads = here.select(F.col("pid").alias("id"), F.col("ph").alias("h"), F.expr("substring(text, 1, pk)").alias("head"))
    n, k = F.char_length("text"), F.floor(F.char_length("text") / 4).cast("int")
    # Of equal rows all but the last are followed by themselves.
    again = F.struct(F.lit(1).alias("turn"), (F.col("copies") - 1).alias("times"), F.substring("text", F.lit(1), k).alias("head"), F.col("id").alias("nid"), F.col("h").alias("nh"))
    onward = F.struct(F.lit(0).alias("turn"), F.lit(1).cast("long").alias("times"), F.col("head").alias("head"), F.col("nid").alias("nid"), F.col("nh").alias("nh"))
    turns = here.join(heads, ["id", "h"]).select("id", "h", "text", n.alias("n"), k.alias("k"), F.explode(F.when(F.col("copies") > 1, F.array(onward, again)).otherwise(F.array(onward))).alias("turn"))
    turns = turns.select("id", "h", "text", "n", "turn.*", F.concat(F.expr("substring(text, 1, n - k)"), F.col("turn.head")).alias("edited")).drop("head")
    cut = turns.select("id", "h", "turn", "times", "nid", "nh", "n", F.sha2("edited", 256).alias("sha"), digests(F.col("text")).alias("a"), digests(F.col("edited")).alias("e"))
    cut = cut.withColumns({"ca": sketch(F.col("a")), "ce": sketch(F.col("e"))})
    # Digests of the edited text are kept from the first one on that differs.
    differs = F.array_position(F.zip_with("a", "e", lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False)).cast("int")
    common = F.when(differs > 0, differs - 1).otherwise(F.size("a"))
    cut = cut.withColumns({"near": _first_try(F.col("a"), F.col("e"), F.col("ca"), F.col("ce")), "common": common, "row": F.monotonically_increasing_id()})
    known = write_scratch(cut.select("row", "id", "h", "turn", "times", "nid", "nh", "n", "sha", "a", "common", F.expr("slice(e, common + 1, size(e))").alias("rest"), F.size("e").alias("ne"), "ca", "ce", "near"), "digests")
    drop_scratch(ring)

    # Pairs of a text and its edited one have even numbers, pairs with the next document odd ones.
    own = known.select("row", "nid", "nh", "a", "common", "rest", "near")
    following = known.where("turn = 0").select(F.col("id").alias("nid"), F.col("h").alias("nh"), F.col("a").alias("b"))

    def edited(which: DataFrame, attempt: int) -> DataFrame:
        both = which.select("row", (F.col("row") * 2).alias("pair"), "near", "a", F.concat(F.slice("a", F.lit(1), F.col("common")), "rest").alias("b"))
        return _larger(both.repartition("row"), ["row"], attempt)

    def onward(which: DataFrame, attempt: int) -> DataFrame:
        both = which.select("row", "nid", "nh", "a").join(following, ["nid", "nh"]).select("nid", "nh", (F.col("row") * 2 + 1).alias("pair"), "a", "b")
        tried = F.lit(None).cast("double") if attempt else _first_try(F.col("a"), F.col("b"), sketch(F.col("a")), sketch(F.col("b")))
        return _larger(both.withColumn("near", tried), ["nid", "nh"], attempt)

    solved = known.where("near is not null").select((F.col("row") * 2).alias("pair"), "near")
    near = write_scratch(onward(own, 0).unionByName(edited(own.where("near is null"), 0)), "near-0")
    attempt = 0
    while True:
        solved = solved.unionByName(near.where("near is not null"))
        stuck = write_scratch(near.where("near is null").select("pair", F.shiftright("pair", 1).alias("row")), "stuck")
        if stuck.isEmpty():
            break
        attempt += 1
        by = lambda odd: write_scratch(own.withColumn("near", F.lit(None).cast("double")).join(stuck.where(F.col("pair") % 2 == odd), "row", "left_semi"), "again")
        near = write_scratch(onward(by(1), attempt).unionByName(edited(by(0), attempt)), f"near-{attempt}")
    both = solved.groupBy(F.shiftright("pair", 1).alias("row")).agg(F.max(F.when(F.col("pair") % 2 == 0, F.col("near"))).alias("near_edited"), F.max(F.when(F.col("pair") % 2 == 1, F.col("near"))).alias("near_next"))
    out = known.select("row", "id", "times", "n", "sha", as_text(F.col("ca"), F.size("a")).alias("fa"), as_text(F.col("ce"), F.col("ne")).alias("fe")).join(both, "row")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return out.select(F.nullif("id", none).alias(id_col), F.col("n").cast("long").alias("n_chars"), F.col("sha").alias("edited_sha256"), F.col("fa").alias("fingerprint"), F.col("fe").alias("edited_fingerprint"), "near_edited", "near_next")
