"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Lines within ``EDITS`` edits: each line is cut into EDITS + 1 segments, of which a
line that near leaves one unchanged, shifted by at most its edits. Segments are
indexed with their number and the line's length; each line probes the lengths not
above its own, at the places where an unchanged segment can lie (Pass-Join: Li and
others, 2011). Pairs that meet are compared by letter counts and then verified by
bit-parallel edit distance in a band of 2 EDITS + 2 diagonals (Hyyro, 2003).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialogmill.llm.common import row_key, settled
from dialogmill.llm.components import components
from dialogmill.operators.skew import salted_join

EDITS = 2
#: Shorter lines, of a few words, are compared for equality only, and left in their texts:
#: headings and the like repeat by nature.
MIN_CHARS = 40
#: Lines with one segment in common above which they are compared in blocks, and lines of a block on average.
MAX_BUCKET = 16
BLOCK = 32
#: Bits of a mask that are used: a block has no more lines.
MASK = 62
#: Lines up to which their ids are sent to all executors, some MB.
MAX_BROADCAST = 500_000
#: Letters counted: an edit changes these counts by two at most.
LETTERS = "etaoinshrdlucmpg"


def lines_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows (doc_id, line_no, line) of \\n-split texts, from 0; null texts have no line."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))


def _segment(number: int, length: Column, edits: int) -> tuple[Column, Column]:
    """Start from 0 and size of a segment of a line of ``length``: sizes differ by one, the longer come last."""
    size = F.floor(length / (edits + 1))
    longer = edits + 1 - (length - size * (edits + 1))
    start = number * size + F.greatest(F.lit(0), number - longer)
    return start.cast("int"), (size + (number >= longer).cast("int")).cast("int")


def _keyed(classes: DataFrame, edits: int) -> DataFrame:
    """Rows (id, index, probe), written: keys under which lines are indexed, and keys they probe.

    Segments are cut from four bytes a character, where a place is found without
    walking the line.
    """
    wide, length = F.col("wide"), F.col("chars")

    def key(number, target, shift):
        start, size = _segment(number, target, edits)
        return F.xxhash64(F.lit(number), target, F.substring(wide, (start + shift) * 4 + 1, size * 4))

    index = [key(i, length, 0) for i in range(edits + 1)]
    probe = [
        key(i, length - less, shift)
        for less in range(edits + 1)
        for i in range(edits + 1)
        for shift in range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1)
    ]
    lines = classes.select("id", "chars", F.encode("line", "UTF-32").alias("wide"))
    return settled(lines.select("id", F.array(*index).alias("index"), F.array(*probe).alias("probe")), "keys")


def within_edits_sql(a: str, b: str, edits: int = EDITS) -> str:
    """Whether a and b, texts whose lengths differ by at most ``edits``, lie within that many edits.

    The band's cells are the bits of a number: bit k at character j of b stands for
    character j + k - edits - 1 of a. Down the band the distance is followed on its
    highest diagonal, and then along the last row.
    """
    width = 2 * edits + 2
    mask, top = (1 << width) - 1, width - 1
    first = ((1 << (edits + 1)) - 1) << (edits + 1)
    bits = " | ".join(
        f"IF(get(a_, j + {k - edits - 1}) = c, {1 << k}L, 0L)" for k in range(width)
    )
    matches = f"transform(split({b}, ''), (c, j) -> {bits})"
    d0 = f"((((((x & s.vp) + s.vp) ^ s.vp) | x) | s.vn) & {mask}L)"
    hp = f"((s.vn | ~({d0} | s.vp)) & {mask}L)"
    hn = f"({d0} & s.vp)"
    # j counts the characters of b; the highest diagonal ends in the last row at length(a) - edits
    along = f"(s.j - (size(a_) - {edits}))"
    bit = f"shiftleft(1L, CAST(greatest({top - 1} - {along}, 0) AS INT))"
    step = (
        f"named_struct('vp', ({hn} | ~(shiftright({d0}, 1) | {hp})) & {mask}L, 'vn', shiftright({d0}, 1) & {hp}, "
        f"'d', IF({along} < 0, s.d + IF(({d0} & {1 << top}L) = 0, 1, 0), "
        f"s.d + IF(({hp} & {bit}) != 0, 1, 0) - IF(({hn} & {bit}) != 0, 1, 0)), 'j', s.j + 1)"
    )
    start = f"named_struct('vp', {first}L, 'vn', 0L, 'd', {edits}, 'j', 0)"
    # exists() over one array binds its letters to a_, so they are split once
    return f"exists(array(split({a}, '')), a_ -> aggregate({matches}, {start}, (s, x) -> {step}, s -> s.d <= {edits}))"


def within_edits(a: str, b: str, edits: int = EDITS) -> Column:
    return F.expr(within_edits_sql(a, b, edits))


def _line_hash() -> Column:
    """16 bytes of a line with a character that is no white space, null for others."""
    return F.when(F.col("line").rlike(r"[^\x20\x09-\x0D]"), F.unhex(F.md5(F.col("line").cast("binary"))))


def line_classes(lines: DataFrame) -> DataFrame:
    """One row per different line that is not blank: id, line, hash, chars, copies, first (doc_id, line_no)."""
    grouped = lines.groupBy("line").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count(F.lit(1)).alias("copies"))
    return settled(
        grouped.select(F.monotonically_increasing_id().alias("id"), "line", _line_hash().alias("hash"), F.length("line").alias("chars"), "copies", "first").where("hash IS NOT NULL"),
        "lines",
    )


def _letters() -> Column:
    return F.array(*[(F.octet_length("line") - F.octet_length(F.replace("line", F.lit(c)))).cast("int") for c in LETTERS])


def _sent(ids: DataFrame) -> DataFrame:
    """Distinct rows, written, and broadcast only if they are few."""
    ids = settled(ids.distinct(), "ids")
    return F.broadcast(ids) if ids.count() <= MAX_BROADCAST else ids


def _like(a: str, b: str, edits: int) -> str:
    return " + ".join(f"abs({a}[{k}] - {b}[{k}])" for k in range(len(LETTERS))) + f" <= {2 * edits}"


def _rare_links(classes: DataFrame, index: DataFrame, probe: DataFrame, hot: DataFrame, edits: int) -> DataFrame:
    """Links (u, v), each once, of lines that share a segment with few others."""
    pair = (F.least("a.id", "b.id").alias("u"), F.greatest("a.id", "b.id").alias("v"))
    rare = index.join(hot.select("key"), "key", "left_anti")
    met = settled(rare.alias("a").join(probe.alias("b"), "key").where("a.id <> b.id").select(*pair).distinct(), "met")
    letters = settled(classes.join(_sent(met.select(F.explode(F.array("u", "v")).alias("id"))), "id", "left_semi").select("id", _letters().alias("letters")), "letters")
    alike = settled(
        met.join(letters.alias("a"), F.col("u") == F.col("a.id")).join(letters.alias("b"), F.col("v") == F.col("b.id"))
        .where(_like("a.letters", "b.letters", edits)).select("u", "v"),
        "alike",
    )
    texts = classes.join(_sent(alike.select(F.explode(F.array("u", "v")).alias("id"))), "id", "left_semi").select("id", "line")
    return (
        alike.join(texts.withColumnsRenamed({"id": "u", "line": "line_u"}), "u")
        .join(texts.withColumnsRenamed({"id": "v", "line": "line_v"}), "v")
        .where(within_edits("line_u", "line_v", edits))
        .select("u", "v")
    )


def _crowded_links(classes: DataFrame, keyed: DataFrame, hot: DataFrame, edits: int) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v) that connect, and rows (id, n_links) that count, the links which only crowded segments show.

    The indexed lines of a segment stand in blocks of at most ``MASK``, and a line that
    probes it meets each block as one row, whose links are the bits of a number. A
    pair counts at the least of the segments it shares, and not here if one of them is
    rare. Bits are summed into links per line; in each block, lines that some line
    links to both are connected, and that line to one of them. So a group of m near
    copies makes m * m / ``BLOCK`` rows, not pairs, and some edges a line.
    """
    own = lambda kind: keyed.select("id", F.explode(kind).alias("key")).join(hot, "key")
    left, right = settled(own("index"), "indexed"), settled(own("probe"), "probing")
    # a line probes its own index keys too, so these are all lines of crowded segments
    crowded = left.groupBy("id").agg(F.collect_set("key").alias("hot"))
    about = settled(
        classes.join(_sent(right.select("id")), "id", "left_semi").select("id", "chars", "line", _letters().alias("letters"))
        .join(keyed, "id").join(crowded, "id", "left")
        .select("id", "chars", "line", "letters", "probe", F.col("hot"), F.array_except("index", F.coalesce("hot", F.array().cast("array<bigint>"))).alias("rare")),
        "crowd",
    )
    chunks = F.ceil(F.col("n") / BLOCK).cast("int")
    place = F.row_number().over(Window.partitionBy("key", "chunk").orderBy("id")) - 1
    placed = left.withColumn("chunk", F.pmod(F.xxhash64("id"), chunks).cast("int")).withColumn("place", place)
    at = ("key", "chunk", "part")
    item = F.struct("place", "id", "chars", "line", "letters", "hot", "rare")
    blocks = settled(
        placed.withColumn("part", F.floor(F.col("place") / MASK)).join(about.drop("probe"), "id").groupBy(*at).agg(F.array_sort(F.collect_list(item)).alias("block")),
        "blocks",
    )
    asking = right.join(about.select("id", "chars", "line", "letters", "probe"), "id").withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
    # lines of one length probe each other, so one of the two meetings is enough
    linked = (
        f"o.id <> id AND (o.chars < chars OR o.id < id) AND {_like('o.letters', 'letters', edits)} AND NOT arrays_overlap(o.rare, probe)"
        f" AND array_min(array_intersect(o.hot, probe)) = key AND {within_edits_sql('o.line', 'line', edits)}"
    )
    mask = F.expr(f"aggregate(transform(block, (o, i) -> IF({linked}, shiftleft(1L, i), 0L)), 0L, (m, bit) -> m | bit)")
    masks = settled(asking.join(blocks, ["key", "chunk"]).select("id", *at, mask.alias("mask")).where("mask <> 0"), "masks")
    ids = blocks.select(*at, F.transform("block", lambda o: o["id"]).alias("ids"))
    bit = lambda k: F.expr(f"shiftright(mask, {k}) & 1L")
    summed = masks.groupBy(*at).agg(
        F.array(*[F.sum(bit(k)) for k in range(MASK)]).alias("sums"),
        # lines that are in one mask with line k
        F.array(*[F.bit_or(F.when(bit(k) == 1, F.col("mask"))) for k in range(MASK)]).alias("beside"),
    )
    both = settled(summed.join(ids, list(at)), "summed")
    in_blocks = both.select(F.explode(F.arrays_zip(F.col("ids").alias("id"), F.slice("sums", F.lit(1), F.size("ids")).alias("n"))).alias("x")).select("x.id", "x.n")
    counts = masks.select("id", F.bit_count("mask").cast("long").alias("n")).unionByName(in_blocks)
    degree = counts.groupBy("id").agg(F.sum("n").alias("n_links")).where("n_links > 0")
    lowest = F.bit_count(F.expr("(mask & -mask) - 1"))
    to_block = masks.join(ids, list(at)).select(F.col("id").alias("u"), F.get("ids", lowest).alias("v"))
    inside = F.expr(
        "flatten(transform(ids, (a, k) -> transform(filter(sequence(0, k), j -> j < k AND shiftright(beside[k], j) & 1L = 1), j -> struct(a AS u, ids[j] AS v))))"
    )
    return to_block.union(both.select(F.explode(inside).alias("e")).select("e.u", "e.v")), degree


def edit_links(classes: DataFrame, edits: int = EDITS) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v) of ids of different lines, and rows (id, n_links).

    ``n_links`` is the number of other lines within ``edits`` edits of a line, none
    lost; lines without are left out. The edges connect just the lines that such links
    connect. Segments shared by over ``MAX_BUCKET`` lines, as of near copies by
    the thousand, are compared in blocks over many tasks.
    """
    keyed = _keyed(classes, edits)
    index = keyed.select("id", F.explode("index").alias("key"))
    probe = keyed.select("id", F.explode("probe").alias("key"))
    hot = settled(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MAX_BUCKET), "segments")
    n_hot = hot.count()
    if n_hot and n_hot <= MAX_BROADCAST:
        hot = F.broadcast(hot)
    links = settled(_rare_links(classes, index, probe, hot, edits), "links")
    degree = links.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    if not n_hot:
        return links, degree
    edges, more = _crowded_links(classes, keyed, hot, edits)
    return links.union(edges), degree.unionByName(more).groupBy("id").agg(F.sum("n_links").alias("n_links"))


def near_lines(
    docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Rows (doc_id, line_no, class_doc_id, class_line_no, n_links, kept), one per line of each text.

    Lines are in one class if they are equal or linked, over other lines too, by at
    most ``edits`` edits; the class is named by its first line, least doc_id (null
    first), then least number. That line is kept, the others are not. ``n_links`` is
    the number of different other lines within ``edits`` of the line. Lines of fewer
    than ``min_chars`` characters are compared for equality only, and have no links;
    blank lines are classes of their own and kept. Null texts have
    no line, an empty text has one empty line. Rows with the same id and text are
    one document, so they keep the same lines. An empty table gives none.
    """
    lines = lines_of(docs, doc_id, text)
    classes = line_classes(lines)
    links, degree = edit_links(classes.where(F.col("chars") >= min_chars), edits)
    roots = components(links)
    linked = roots.withColumnRenamed("node", "id").join(degree, "id").join(classes.select("id", "hash", "first"), "id")
    heads = linked.groupBy("root").agg(F.min("first").alias("head"))
    linked = linked.join(heads, "root").select("hash", "head", "n_links")
    # lines that are neither repeated nor linked are looked up by nobody
    alone = classes.where("copies > 1").select("hash", "first").join(linked.select("hash"), "hash", "left_anti").select("hash", F.col("first").alias("head"), F.lit(0).cast("long").alias("n_links"))
    named = settled(linked.unionByName(alone), "named")
    hashed = lines.select("doc_id", "line_no", _line_hash().alias("hash"))
    own = F.struct("doc_id", "line_no")
    # a common line, and the blank ones without a hash, are spread over several tasks
    found = salted_join(hashed, named, ["hash"], ["doc_id", "line_no"], "left", salts=16).withColumn("head", F.coalesce("head", own))
    return found.select(
        "doc_id", "line_no",
        F.col("head.doc_id").alias("class_doc_id"), F.col("head.line_no").alias("class_line_no"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        own.eqNullSafe(F.col("head")).alias("kept"),
    )


def drop_near_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` (with doc_id, text and maybe n_chars) with texts of their kept lines only.

    Lines of fewer than ``min_chars`` characters go if an earlier one is equal; blank
    lines stay. A document of whose lines none is left goes; null and empty texts stay. Rows of one doc_id but different
    texts are told apart by their texts. ``n_chars`` follows the text.
    """
    key = row_key("doc_id", "text")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), key.alias("_key"))
    # line numbers are of one document if the key stands for its id
    found = near_lines(docs.select(F.struct("doc_id", key.alias("key")).alias("doc_id"), "text"), edits, min_chars)
    gone = found.where("NOT kept").groupBy(F.col("doc_id.key").alias("_key")).agg(F.collect_set("line_no").alias("gone"))
    lines = F.split(F.col("row.text"), "\n", -1)
    left = F.filter(lines, lambda line, at: ~F.array_contains(F.col("gone"), at))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).when(F.size(left) > 0, F.array_join(left, "\n"))
    joined = keyed.join(gone, "_key", "left").withColumn("_text", text).where("gone IS NULL OR _text IS NOT NULL")
    columns = [F.col("_text").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    out = joined.select(*columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
