"""Line dedup over the whole corpus: exact copies and lines within one character edit; the earliest stays.

Only DataFrame functions are used.  All lines but empty ones take part.  Exact copies are one class, known by
two 64-bit hashes, whose place is its earliest one: smallest doc_id, then row, then line number.  A row has a
number of its own, in the order in which the table is read, so rows that share an id, or have none, are
documents of their own.

Edits are looked for between lines of at least ``EDIT_CHARS`` characters: in shorter ones a single character
tells different lines apart ("Part 1", "Part 2"), so they meet exact copies only.

Classes within one edit of each other are found through deletion neighbourhoods:

* A substitution at position p leaves the same text when character p is deleted from both lines; an
  insertion turns a line into another one's deletion variant.  Variants are keyed by what is deleted
  (or kept whole, for the shorter line), so equal keys are exactly the pairs within the bound.
* One edit leaves the first or the second half alone.  Lines that share neither half with another class
  need no variants, and a line that shares a half needs variants of its other half only.
* A half is taken in blocks of ``_block`` characters (64, or the square root of a longer line's length): a
  variant is known by hashes of the text before and behind its block, taken once a block, and by the block
  without the character.  So a line of n characters costs n times the square root of n steps, not n squared.
* A key's members are compared with the earliest of them, not with each other; that pair's edit distance is
  verified on the texts.

A class is dropped if a class within the bound has an earlier place; of the others, the earliest place is
kept and all further copies are dropped.

Defined results: null texts stay null; empty lines always stay; a document that loses every line has an empty
text and stays a row; rows that repeat an id or a whole row keep apart (the first keeps its lines); a null id
comes first; an empty table gives an empty result; all columns but ``text`` are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, numbered

#: Lines shorter than this meet exact copies only.
EDIT_CHARS = 20
#: Tables up to this size may be sent to every executor; larger ones are shuffled.
BROADCAST_BYTES = 16 << 20
_FIRST_ID = -(1 << 63)


def _small(df: DataFrame, row_bytes: Column) -> DataFrame:
    """A materialised table, to be broadcast if its rows, of so many bytes each, are few enough."""
    size = df.agg(F.sum(row_bytes.cast("long")).alias("b")).first()["b"] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _lines(rows: DataFrame) -> DataFrame:
    """place, line of the lines that take part."""
    first = F.coalesce(F.col("row.doc_id").cast("long"), F.lit(_FIRST_ID))
    each = rows.where("row.text is not null").select(first.alias("id"), "rid", F.posexplode(F.split(F.col("row.text"), "\n")).alias("line_no", "line"))
    return each.where("line <> ''").select(F.struct("id", "rid", "line_no").alias("place"), "line")


def _half_keys(line: Column) -> Column:
    """Of lines taken as m characters long, for m the length and one less: hashes of the two halves."""
    n = F.length(line)

    def keys(less: int):
        m = n - less
        k = F.floor(m / 2).cast("int")
        return (
            F.struct(F.lit(0).alias("side"), F.lit(less).alias("less"), F.xxhash64(F.lit(0), m, F.substring(line, F.lit(1), k)).alias("key")),
            F.struct(F.lit(1).alias("side"), F.lit(less).alias("less"), F.xxhash64(F.lit(1), m, F.substring(line, n - (m - k) + 1, m - k)).alias("key")),
        )

    return F.array(*keys(0), *keys(1))


def _other_half(line: Column, side: Column, less: Column) -> Column:
    n = F.length(line)
    m = n - less
    k = F.floor(m / 2).cast("int")
    return F.when(side == 0, F.substring(line, k + 1, n)).otherwise(F.substring(line, F.lit(1), n - (m - k)))


def _block(size: Column) -> Column:
    return F.greatest(F.lit(64), F.ceil(F.sqrt(size.cast("double"))).cast("int"))


def _blocks(halves: DataFrame) -> DataFrame:
    """place, less, at, mid, outer: the blocks of the other halves (``rest``).  ``at`` is where the block starts,
    ``outer`` a hash of the shared half and of what stands before and behind the block.

    The half of a line taken as one shorter is cut where the shorter line's half is: its blocks hold one
    character more, and the text behind them is the same, counted from the end.
    """
    rest = F.col("rest")
    size = F.length(rest) - F.col("less")
    sized = halves.withColumn("size", size).withColumn("block", _block(F.col("size")))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("size") - 1) / F.col("block")).cast("int")))
    each = sized.withColumn("j", F.explode(starts)).withColumn("at", (F.col("j") * F.col("block")).cast("int"))
    last = F.col("at") + F.col("block") >= F.col("size")
    width = F.when(last, F.length(rest) - F.col("at")).otherwise(F.col("block") + F.col("less"))
    before = F.xxhash64(F.substring(rest, F.lit(1), F.col("at")))
    behind = F.xxhash64(F.substring(rest, F.col("at") + width + 1, F.length(rest)))
    return each.select("place", "less", "at", F.substring(rest, F.col("at") + 1, width).alias("mid"), F.xxhash64("key", "at", before, behind).alias("outer"))


def _variants(blocks: DataFrame) -> DataFrame:
    """v (key), role, place of every variant.  Roles: 0 one character deleted from each of two equally long
    lines, at the same position; 1 the whole (shorter) line; 2 one character deleted from the longer."""
    mid = F.col("mid")
    cut = F.transform(
        F.sequence(F.lit(1), F.length(mid)),
        lambda p: F.xxhash64(
            F.col("outer"), F.when(F.col("less") == 0, p).otherwise(F.lit(0)), F.concat(F.substring(mid, F.lit(1), p - 1), F.substring(mid, p + 1, F.length(mid)))
        ),
    )
    deleted = blocks.where("mid <> ''").select("place", F.when(F.col("less") == 0, 0).otherwise(2).alias("role"), F.explode(cut).alias("v"))
    whole = blocks.where("less = 0").select("place", F.lit(1).alias("role"), F.xxhash64("outer", F.lit(0), "mid").alias("v"))
    # a run of one character gives the same variant at several positions
    return deleted.unionByName(whole)


def _within_one(x: Column, y: Column) -> Column:
    """Whether at most one character is inserted, deleted or replaced: the lines part at one place (found by
    bisection) and agree behind it.  (``levenshtein`` takes time with the square of a line's length.)"""
    shorter = F.least(F.length(x), F.length(y))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(shorter + 1)).cast("int"))

    def halve(span, _):
        mid = F.ceil((span["low"] + span["high"]) / 2).cast("int")
        same = F.substring(x, F.lit(1), mid) == F.substring(y, F.lit(1), mid)
        return F.struct(F.when(same, mid).otherwise(span["low"]).alias("low"), F.when(same, span["high"]).otherwise(F.greatest(span["low"], mid - 1)).alias("high"))

    k = F.aggregate(steps, F.struct(F.lit(0).alias("low"), shorter.alias("high")), halve, lambda span: span["low"])
    behind = lambda line, at: F.substring(line, at, F.length(line))
    gap = F.length(x) - F.length(y)
    return (
        F.when(gap == 0, behind(x, k + 2) == behind(y, k + 2)).when(gap == -1, behind(x, k + 1) == behind(y, k + 2))
        .when(gap == 1, behind(x, k + 2) == behind(y, k + 1)).otherwise(False)
    )


def _classes(rows: DataFrame) -> DataFrame:
    """place, keys of every class of equal lines."""
    line = F.col("line")
    keys = F.when(F.length(line) >= EDIT_CHARS, _half_keys(line))
    hashed = _lines(rows).select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"), "place", keys.alias("keys"))
    return materialise(hashed.groupBy("h1", "h2").agg(F.min("place").alias("place"), F.first("keys").alias("keys")), "line-classes")


def _losers(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Places of the classes that have an earlier neighbour."""
    halves = classes.select("place", F.explode("keys").alias("k")).select("place", "k.side", "k.less", "k.key")
    # a half must be shared, and a line taken as one shorter needs a line of that length
    met = halves.groupBy("side", "key").agg(F.count("*").alias("n"), F.min("less").alias("low")).where("n > 1 and low = 0").select("side", "key")
    # few rows in many partitions: gathered into few files
    shared = materialise(halves.join(met, ["side", "key"], "left_semi").hint("rebalance"), "line-shared")
    wanted = materialise(shared.select("place").distinct(), "line-wanted")
    texts = materialise(_lines(rows).join(_small(wanted, F.lit(72)), "place", "left_semi"), "line-texts")
    filled = shared.join(texts, "place").select("place", "less", "key", _other_half(F.col("line"), F.col("side"), F.col("less")).alias("rest"))
    variants = materialise(_variants(_blocks(filled)), "line-variants")
    discard(shared, wanted)
    first = lambda role: F.min(F.when(F.col("role") == role, F.col("place"))).alias(f"p{role}")
    groups = variants.groupBy("v").agg(first(0), first(1), first(2), F.max("place").alias("last"))
    alive = groups.where((F.col("p0") < F.col("last")) | (F.col("p1").isNotNull() & F.col("p2").isNotNull()))
    alive = materialise(alive.drop("last"), "line-groups")
    partner = F.when(F.col("role") == 0, F.col("p0")).when(F.col("role") == 1, F.col("p2")).otherwise(F.col("p1"))
    pairs = variants.join(_small(alive, F.lit(144)), "v").select("place", partner.alias("before")).where("before < place").distinct()
    one = texts.select("place", "line")
    other = texts.select(F.col("place").alias("before"), F.col("line").alias("line2"))
    near = pairs.join(one, "place").join(other, "before").where(_within_one(F.col("line"), F.col("line2")))
    lost = materialise(near.select("place").distinct(), "line-lost")
    discard(variants, alive, texts)
    return lost


def _kept(rows: DataFrame) -> DataFrame:
    """rid, kept: numbers of the lines that stay (but for empty ones), for rows that lose at least one."""
    classes = _classes(rows)
    lost = _losers(rows, classes)
    stay = classes.select("place").join(lost, "place", "left_anti").select("place.rid", "place.line_no")
    kept = stay.groupBy("rid").agg(F.array_sort(F.collect_list("line_no")).alias("kept"))
    taking = F.size(F.filter(F.split(F.col("row.text"), "\n"), lambda x: x != ""))
    have = rows.where("row.text is not null").select("rid", taking.alias("have")).where("have > 0")
    both = have.join(kept, "rid", "left").select("rid", "have", F.coalesce("kept", F.array().cast("array<int>")).alias("kept"))
    out = materialise(both.where(F.size("kept") < F.col("have")).select("rid", "kept"), "line-kept")
    discard(classes, lost)
    return out


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All rows and columns of docs, with the dropped lines taken out of ``text``."""
    rows = numbered(docs, "line-rows")
    kept = _kept(rows)
    joined = rows.join(_small(kept, F.lit(32) + 4 * F.size("kept")), "rid", "left").withColumn("lines", F.when(F.col("kept").isNotNull(), F.split(F.col("row.text"), "\n")))
    # the lines are looked up by their numbers; ``lines`` is used twice, so it is not worked out again for each
    blank = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.get("lines", i) == "")
    stays = joined.withColumn("at", F.when(F.col("kept").isNotNull(), F.array_sort(F.concat("kept", blank))))
    text = F.coalesce(F.array_join(F.transform("at", lambda i: F.get("lines", i)), "\n"), F.col("row.text"))
    return stays.select(*((text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def line_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (after), n_chars, text_md5 of the deduplicated texts."""
    done = dedup_lines(docs.select("doc_id", "text"))
    return done.select("doc_id", F.size(F.split("text", "\n")).alias("n_lines"), F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(doc_id, {_FIRST_ID}) AS id, doc_id, text FROM documents
), l AS (
  SELECT id, rid, CAST(u.i AS INTEGER) AS i, s[u.i] AS line
  FROM (SELECT id, rid, string_split(text, chr(10)) AS s FROM d WHERE text IS NOT NULL), LATERAL (SELECT unnest(generate_series(1, len(s))) AS i) u
), c AS (
  SELECT line, length(line) AS n, min((id, rid, i)) AS place FROM l WHERE line <> '' GROUP BY line
), e AS (
  SELECT * FROM c WHERE n >= {EDIT_CHARS}
), p AS (
  SELECT a.place, a.line AS x, b.line AS y FROM e a JOIN e b ON left(a.line, CAST(floor((a.n - 1) / 2) AS INTEGER)) = left(b.line, CAST(floor((a.n - 1) / 2) AS INTEGER))
    AND abs(a.n - b.n) <= 1 AND b.place < a.place
  UNION
  SELECT a.place, a.line AS x, b.line AS y FROM e a JOIN e b ON right(a.line, CAST(floor((a.n - 1) / 2) AS INTEGER)) = right(b.line, CAST(floor((a.n - 1) / 2) AS INTEGER))
    AND abs(a.n - b.n) <= 1 AND b.place < a.place
), near AS (
  SELECT DISTINCT place FROM p WHERE len(list_filter(generate_series(0, least(length(x), length(y))), lambda k:
    left(x, CAST(k AS INTEGER)) = left(y, CAST(k AS INTEGER)) AND (
      (length(x) = length(y) AND substr(x, CAST(k + 2 AS INTEGER)) = substr(y, CAST(k + 2 AS INTEGER)))
      OR (length(x) + 1 = length(y) AND substr(x, CAST(k + 1 AS INTEGER)) = substr(y, CAST(k + 2 AS INTEGER)))
      OR (length(x) = length(y) + 1 AND substr(x, CAST(k + 2 AS INTEGER)) = substr(y, CAST(k + 1 AS INTEGER)))))) > 0
), stay AS (
  SELECT place FROM c WHERE place NOT IN (SELECT place FROM near)
), done AS (
  SELECT l.rid, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY i) AS text FROM l
  WHERE line = '' OR (id, l.rid, i) IN (SELECT place FROM stay) GROUP BY l.rid
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE CAST(coalesce(nullif(n_lines, 0), 1) AS INTEGER) END AS n_lines,
       CASE WHEN d.text IS NULL THEN NULL ELSE CAST(length(coalesce(done.text, '')) AS INTEGER) END AS n_chars,
       CASE WHEN d.text IS NULL THEN NULL ELSE md5(coalesce(done.text, '')) END AS text_md5
FROM d LEFT JOIN done USING (rid)
"""
