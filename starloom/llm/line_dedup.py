"""Remove lines that occurred before, exactly or within a few edits.

Two lines within `edits` edits (signs inserted, deleted or replaced) share a piece: cut one into
edits + 1 segments, and one of them stands unchanged in the other, moved by at most the edits next to
it. So each line is entered under its segments and looked up under the substrings that can equal a
segment of a line as long as it or up to `edits` shorter; positions further off are skipped, as they
would leave too many edits on one side.

No pairs are made, as lines with a long part in common would make them by the square of their
number. A first semi-join keeps the entries and lookups that meet another line; a second one, over these
alone and with the lines' texts, keeps the lines that meet an earlier one within `edits`. Lines are first held
against each other by counts of their signs, in groups: an edit changes two counts by one at most. Those left
are verified by a banded bit-parallel edit distance (`within`).

A piece that more than MOST_TOGETHER lines share (a template, a path) would still be compared by the square. Of two
lines within `edits` that share a piece, what is left of them without it is within `edits` too. So those lines
are entered and looked up again, under the piece and the segments of the rest, until few share all of it. Rests too
short for segments are entered under all that up to `edits` deletions leave of them, of which two within `edits`
have one in common.

Which line came before is by (doc_id, line number). A line goes if an equal one, or one whose first
occurrence is earlier than its own first and that is within `edits`, came before. All lines are
judged on the input, not on what is left. Lines shorter than `min_chars` take no part in the search for near
lines; exact repeats of them go too if `short_repeats`, unless they are blank (white space alone).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import Scratch

#: Of lines that are more than this share of all lines, later occurrences are left out of the
#: search at once. There are at most 1 / HOT_SHARE such lines, which bounds their table.
HOT_SHARE = 1e-5

#: A key with more entries and lookups than this is refined, so many times at most.
MOST_TOGETHER, REFINEMENTS = 1000, 12


def lookups(edits: int) -> list[tuple[int, int, int]]:
    """(how much shorter the other line is, segment, how far it stands moved) of each substring that
    can equal a segment of another line. (0, segment, 0) are the line's own segments."""
    out = []
    for shorter in range(edits + 1):
        for i in range(edits + 1):
            # edits before the segment move it by at most i, those after it leave edits - i
            low, high = max(-i, shorter - (edits - i)), min(i, shorter + (edits - i))
            out += [(shorter, i, move) for move in range(low, high + 1)]
    return out


def keys(lines: DataFrame, edits: int, text: str = "line", carried: Sequence[str] = ("h1",), salt: Sequence[str] = ()) -> DataFrame:
    """Of `lines`: the `carried` columns, key, `own` (whether the piece is one of the text's own segments), and where the
    piece stands: start, size. `salt`: columns that make the key besides the piece."""
    k = edits + 1
    wanted = F.array(*[F.struct(*map(F.lit, x)) for x in lookups(edits)])
    wanted = wanted.cast("array<struct<shorter: int, i: int, move: int>>")
    each = lines.withColumn("n", F.char_length(text)).withColumn("w", F.explode(wanted))
    each = each.select(*lines.columns, "n", "w.*")
    # of n signs the first segments have n div k, the last n mod k of them one more
    target = F.col("n") - F.col("shorter")
    base, longer = F.expr(f"(n - shorter) div {k}").cast("int"), target % k
    before_longer = k - longer
    start = base * F.col("i") + F.greatest(F.col("i") - before_longer, F.lit(0)) + 1 + F.col("move")
    each = each.withColumns(
        {"start": start, "size": base + (F.col("i") >= before_longer).cast("int"), "target": target}
    )
    each = each.filter("start >= 1 AND start + size - 1 <= n AND size > 0")
    piece = F.substring(text, F.col("start"), F.col("size"))
    return each.select(
        *carried,
        F.xxhash64(*salt, piece, "target", "i").alias("key"),
        ((F.col("shorter") == 0) & (F.col("move") == 0)).alias("own"),
        "start",
        "size",
    )


#: Groups of signs that are counted; all others are one more, by the length.
SIGNS = ("aAqQ", "eEjJ", "iIxX", "oOzZ", "uUkK", "nNvV", "tTfF", "sSwW", "rRyY", "lLbBpP", "dDcCmM", "hHgG", "0369", "1478", "25")


def sign_counts(text: str) -> dict[str, Column]:
    """Columns c0, c1, ...: how many signs of each group a text has."""
    return {f"c{k}": F.char_length(text) - F.char_length(F.translate(text, signs, "")) for k, signs in enumerate(SIGNS)}


def within(x: str, y: str, edits: int) -> str:
    """SQL: whether two texts, the first not empty and their lengths at most `edits` apart, are within
    `edits` of each other.

    For each number of errors e a word r_e holds, as bits, the diagonals (how much further the second text
    is read than the first) that can be reached with e errors; the band has 2 * edits + 1 of them. One sign of
    the first text moves all diagonals at once: along those where the signs agree, and from e - 1 errors by
    replacing the sign, by deleting it (one diagonal down), or by inserting another after it (one up).
    """
    a, b = "signs.a", "signs.b"  # each text is cut into its signs once
    agree = " + ".join(
        f"if(i{d:+d} >= 0 AND get({a}, i) <=> get({b}, i{d:+d}), {1 << (d + edits)}, 0)" for d in range(-edits, edits + 1)
    )
    band = (1 << (2 * edits + 1)) - 1
    start = ", ".join(f"'r{e}', {sum(1 << (edits + d) for d in range(e + 1))}" for e in range(edits + 1))
    moved = ["(s.r0 & agree)"]
    for e in range(1, edits + 1):
        inserted = f"(shiftleft({moved[-1]}, 1) & {band})"
        moved.append(f"((s.r{e} & agree) | s.r{e - 1} | shiftright(s.r{e - 1}, 1) | {inserted})")
    step = ", ".join(f"'r{e}', {x}" for e, x in enumerate(moved))
    ends = f"shiftleft(1, size({b}) - size({a}) + {edits})"
    reached = (
        f"aggregate(transform(sequence(0, size({a}) - 1), i -> {agree}), named_struct({start}),"
        f" (s, agree) -> named_struct({step}), s -> (s.r{edits} & {ends}) != 0)"
    )
    return f"exists(array(named_struct('a', split({x}, ''), 'b', split({y}, ''))), signs -> {reached})"


def _order(doc_id: Column, line_no: Column) -> Column:
    """Documents without an id come last."""
    return F.coalesce(doc_id.cast("decimal(20,0)"), F.lit("99999999999999999999").cast("decimal(20,0)")) * F.lit(
        1 << 31
    ).cast("decimal(10,0)") + line_no.cast("decimal(10,0)")


def dedupe_lines(
    docs: DataFrame, scratch: Scratch, edits: int, min_chars: int, short_repeats: bool = False
) -> DataFrame:
    """`docs` (doc_id, text, and any others) with `text` less the removed lines, n_lines and n_removed.

    Lines end at "\\n". A null text stays null, without lines; an empty one has one line. Equal rows lose
    the same lines. Rows that share a doc_id but differ in their texts are told apart, but of lines
    at the same place in them none is the earlier.
    """
    if min_chars <= edits:
        raise ValueError("min_chars must be above edits, for no segment to be empty")
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text"
    )
    cut = F.split("text", "\n", -1)
    each = texts.select("doc_id", "text_hash", F.posexplode(cut).alias("line_no", "line"))
    each = each.withColumn("n_chars", F.char_length("line"))
    long_enough = F.col("n_chars") >= min_chars
    counted = long_enough | F.col("line").rlike(r"(?U)\S") if short_repeats else long_enough
    lines = each.filter(counted).withColumns(
        {
            "h1": F.xxhash64("line"),
            "h2": F.xxhash64(F.lit(1), "line"),
            "place": _order(F.col("doc_id"), F.col("line_no")),
        }
    )
    kept = scratch.keep(lines.drop("line", "n_chars"), "lines")
    by_line = kept.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    firsts = scratch.keep(by_line, "firsts")

    # places of lines equal to an earlier one
    equal = kept.join(firsts.select("h1", "h2", "first"), ["h1", "h2"]).filter("place > first")
    # entries and lookups that meet another line
    total = firsts.agg(F.sum("n")).first()[0] or 0
    hot = firsts.filter(F.col("n") > total * HOT_SHARE).select("h1", "h2", F.col("first").alias("only"))
    searched = lines.filter(long_enough).join(F.broadcast(hot), ["h1", "h2"], "left")
    searched = searched.filter("only IS NULL OR place = only")
    entries = keys(searched, edits).select("h1", "key", "own")
    a, b = entries.alias("a"), entries.alias("b")
    meets = (F.col("a.key") == F.col("b.key")) & (F.col("a.h1") != F.col("b.h1"))
    met = a.join(b, meets & (F.col("a.own") | F.col("b.own")), "left_semi")
    met = scratch.keep(met.select("h1", "key", "own").distinct(), "met")

    # the texts of these lines, at their first places
    wanted = met.select("h1").distinct()
    places = firsts.join(wanted, "h1").withColumnRenamed("first", "place")
    at = kept.join(places.select("h1", "h2", "place"), ["h1", "h2", "place"])
    lines_of = at.groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.struct("line_no", "h1", "h2", "place")).alias("wanted")
    )
    same_doc = _same_doc(texts, lines_of)
    found = (
        texts.join(lines_of.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"}), same_doc)
        .select(cut.alias("all"), F.explode("wanted").alias("w"))
        .select("w.h1", "w.h2", "w.place", F.get("all", F.col("w.line_no")).alias("line"))
        .dropDuplicates(["h1", "h2"])
    )
    found = scratch.keep(found.withColumns(sign_counts("line")), "found")
    late = scratch.keep(late_lines(met, found, scratch, edits).distinct(), "near")
    near_places = kept.join(late, ["h1", "h2", "place"])

    columns = ["doc_id", "text_hash", "line_no"]
    gone = scratch.keep(equal.select(*columns).union(near_places.select(*columns)).distinct(), "gone")
    removed = gone.groupBy("doc_id", "text_hash").agg(F.collect_list("line_no").alias("removed"))
    removed = removed.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    others = [c for c in docs.columns if c not in ("n_lines", "n_removed", "text_hash", "_id", "_hash", "removed")]
    whole = docs.select(*others).withColumn("text_hash", F.xxhash64("text"))
    joined = whole.join(removed, _same_doc(whole, removed), "left")
    n = F.coalesce(F.size(cut), F.lit(0))
    left = F.array_except(F.sequence(F.lit(0), n - 1), F.col("removed"))
    text = F.array_join(F.transform(left, lambda i: F.get(cut, i)), "\n")
    return joined.select(
        *[c for c in others if c != "text"],
        F.when(F.col("removed").isNull(), F.col("text")).otherwise(text).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(n).cast("long").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
    )


def late_lines(met: DataFrame, found: DataFrame, scratch: Scratch, edits: int) -> DataFrame:
    """h1, h2, place of the lines within `edits` of a line of an earlier place.

    `met`: h1, key, own. `found`: h1, h2, place, line and sign counts of these lines.
    """
    # `owns`: bit k is set if the piece of refinement k is one of the line's own
    rows = met.select("h1", "key", F.col("own").cast("long").alias("owns"))
    late = []
    for step in range(REFINEMENTS + 1):
        meeting = rows.groupBy("key").agg(F.count("*").alias("n"), F.expr("bit_or(owns)").alias("any"))
        meeting = meeting.filter((F.col("n") > 1) & (F.col("any") == _all_owns(step)))
        meeting = scratch.keep(meeting.select("key", (F.col("n") > MOST_TOGETHER).alias("is_hot")), f"keys{step}")
        hot, cold = meeting.filter("is_hot").select("key"), meeting.filter("NOT is_hot").select("key")
        last = step == REFINEMENTS or hot.isEmpty()
        together = rows.join(meeting if last else cold, "key", "left_semi").select("h1", "key", "owns")
        late.append(_late(together.join(found, "h1"), step, edits))
        if last:
            break
        if step == 0:
            # where the pieces stand was not carried along; of few lines it is worked out again
            of_hot = met.join(hot, "key", "left_semi").select("h1").distinct()
            lines = found.join(of_hot, "h1", "left_semi").select("h1", F.col("line").alias("rest"))
            rows = keys(lines, edits, "rest", ("h1", "rest")).withColumn("owns", F.col("own").cast("long"))
        spans = rows.join(hot, "key", "left_semi")
        before = F.substring("rest", F.lit(1), F.col("start") - 1)
        after = F.substring("rest", F.col("start") + F.col("size"), F.lit(1 << 30))
        spans = spans.select("h1", "key", "owns", F.concat(before, after).alias("rest")).distinct()
        spans = scratch.keep(spans.withColumn("n_rest", F.char_length("rest")), f"rest{step}")
        # of two rests one may be too short for segments; the other is longer by `edits` at most
        short = spans.filter(F.col("n_rest") <= 3 * edits).withColumn("left", F.explode(F.expr(_deletions("rest", edits))))
        short = short.select("h1", F.xxhash64("key", "left").alias("key"), "owns").distinct()
        late.append(_late(short.join(found, "h1"), step, edits))
        long = spans.filter(F.col("n_rest") > 2 * edits).withColumnRenamed("key", "before")
        refined = keys(long, edits, "rest", ("h1", "owns", "rest"), ("before",))
        bit = F.when(F.col("own"), 1 << (step + 1)).otherwise(0).cast("long")
        refined = refined.select("h1", "key", F.col("owns").bitwiseOR(bit).alias("owns"), "rest", "start", "size").distinct()
        rows = scratch.keep(refined, f"refined{step}")
    out = late[0]
    for more in late[1:]:
        out = out.unionByName(more)
    return out


def _all_owns(step: int) -> int:
    return (1 << (step + 1)) - 1


def _deletions(text: str, edits: int) -> str:
    """SQL: all that up to `edits` deletions leave of a text."""
    out = f"array({text})"
    for _ in range(edits):
        one = "transform(sequence(1, char_length(s)), p -> concat(substring(s, 1, p - 1), substring(s, p + 1)))"
        out = (
            f"aggregate(array({out}), array(''), (acc, some) -> array_distinct(concat(some, flatten(transform(some,"
            f" s -> if(s = '', array(s), {one}))))))"
        )
    return out


def _late(known: DataFrame, step: int, edits: int) -> DataFrame:
    """Of lines with their keys, those that share one with a line of an earlier place and are within `edits` of it."""
    y, x = known.alias("y"), known.alias("x")
    counts = [F.abs(F.col(f"x.c{k}") - F.col(f"y.c{k}")) for k in range(len(SIGNS))]
    lengths = F.char_length("x.line") - F.char_length("y.line")
    apart = counts[0]
    for c in counts[1:]:
        apart = apart + c
    near = (
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.place") < F.col("y.place"))
        & (F.col("x.owns").bitwiseOR(F.col("y.owns")) == _all_owns(step))
        & (apart <= 2 * edits)
        & (F.abs(lengths) <= edits)
        & F.expr(within("x.line", "y.line", edits))
    )
    return y.join(x, near, "left_semi").select("h1", "h2", "place")


def _same_doc(texts: DataFrame, lines_of: DataFrame) -> Column:
    return F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
