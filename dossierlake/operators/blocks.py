"""Document structure: blocks from a stream of paragraphs and tables, grids from spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierlake import fixed
from dossierlake.functions import text as T
from dossierlake.operators import scan

# fixed values: list labels that show a guideline hierarchy
LABELS = {
    "1)": r"^\d+\)\s",
    "가)": r"^[가-힣]\)\s",
    "①": r"^[①-⑳]\s?",
    "·": r"^[•·]\s",
    "-": r"^[-–—]\s",
    "Ÿ": r"^Ÿ\s",
    "I.": r"^[IVX]+\.\s",
}
EMPTY_RUN = 3


def _section(tables_alone: bool) -> str:
    return fixed.SECTION_NUMBER_ANY_DEPTH if tables_alone else fixed.SECTION_NUMBER


def _flags(elements: DataFrame, section: str) -> DataFrame:
    text = F.trim(F.coalesce("text", F.lit("")))
    paragraph = F.col("kind") == "paragraph"
    heading = F.coalesce(F.col("is_heading"), F.lit(False))
    toc = paragraph & F.coalesce(F.col("text"), F.lit("")).rlike(fixed.CONTENTS_LINE)
    return (
        elements.withColumn("text", text)
        .withColumn("is_toc", toc)
        .withColumn(
            "opens",
            paragraph & ~toc
            & (heading | text.rlike(fixed.CAPTION) | text.rlike(section)),
        )
        .withColumn("is_heading", heading)
    )


def segments(
    elements: DataFrame, doc: list[str], tables_alone: bool = False, hot: bool | None = None
) -> DataFrame:
    """Number the natural segments: headings, captions and numbered lines open one, a table
    closes one, a run of contents lines is one of its own.

    ``elements`` has doc, ord, kind (paragraph or table), text, is_heading. With
    ``tables_alone`` a table never joins the paragraphs before it and three or more empty
    paragraphs in a row are a boundary as well.
    """
    flagged = _flags(elements, _section(tables_alone))
    empty = (F.col("kind") == "paragraph") & (F.col("text") == "")
    same = ~(
        F.col("_kind").isNull() | (F.col("_kind") == "table") | (F.col("_toc") != F.col("is_toc")) | F.col("opens")
    )
    if tables_alone:
        gap = F.col("ord") - F.col("_ord") - 1 >= EMPTY_RUN
        same = same & (F.col("kind") != "table") & ~gap
    return scan.runs(
        flagged.filter(~empty), doc, "ord", same,
        {"_toc": F.col("is_toc"), "_kind": F.col("kind"), "_ord": F.col("ord")}, name="segment", hot=hot,
    )


#: Paragraphs of a slice and, where a document is large, slices or groups of slices of one group.
CUT_SLICE, CUT_LEVELS = 256, 2


def _table(of_entry) -> Column:
    """What ``of_entry`` gives for each of the 60 places at which a cut can enter a slice."""
    return F.transform(F.sequence(F.lit(0), F.lit(fixed.FORCE_CUT_PARAGRAPHS - 1)), of_entry)


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, although ``use`` looks at it again and again."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _state(off: Column, cuts: Column) -> Column:
    return F.struct(off.cast("int").alias("off"), cuts.cast("long").alias("cuts"))


def _through(state: Column, table: Column) -> Column:
    """State behind a slice: place of the first cut in the next one (-1: none follows) and cuts so far."""
    found = F.element_at(table, F.greatest(state.off, F.lit(0)) + 1)
    return F.when(state.off < 0, state).otherwise(_state(found.off, state.cuts + found.cuts))


def _hops(sizes: Column, first: Column) -> Column:
    """For every paragraph of a slice, how many later ones fill a block that starts behind the one
    before it; 0 where the segment ends sooner. The first paragraph of a segment is never cut off alone."""

    def hop(x: Column) -> Column:
        def step(acc: Column, size: Column) -> Column:
            n, chars = acc.n + 1, acc.chars + size
            full = ((n >= fixed.FORCE_CUT_PARAGRAPHS) | (chars >= fixed.FORCE_CUT_CHARS)) & ~(first & (x == 0) & (n == 1))
            return F.struct(n.alias("n"), chars.alias("chars"), F.when(acc.hop > 0, acc.hop).when(full, n).otherwise(0).alias("hop"))

        start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("chars"), F.lit(0).alias("hop"))
        return F.aggregate(F.slice(sizes, x + 1, F.lit(fixed.FORCE_CUT_PARAGRAPHS)), start, step, lambda acc: acc.hop)

    return F.transform(F.sequence(F.lit(0), F.lit(CUT_SLICE - 1)), hop)


def _walk(hops: Column, entry: Column, finish=None) -> Column:
    """Cuts at or behind ``entry`` inside a slice; the last may lie in the next slice, -1 says that none follows."""

    def step(marks: Column, x: Column) -> Column:
        hop = F.element_at(hops, x + 1)
        return F.when(F.element_at(marks, -1) != x, marks).otherwise(
            F.concat(marks, F.array(F.when(hop > 0, x + hop).otherwise(F.lit(-1))))
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(CUT_SLICE - 1)), F.array(entry.cast("int")), step, finish)


def _entries(tables: DataFrame, keys: list[str], levels: int) -> DataFrame:
    """State in which every slice (keys, s, table) is entered.

    The tables of a segment are followed from its start in one row. With ``levels`` those of 256
    slices are first joined into one, so that the row stays short however long the segment is.
    """

    def follow(parts: Column, start: Column) -> Column:
        def step(acc: Column, part: Column) -> Column:
            out = F.concat(acc.out, F.array(F.struct(part.s.alias("s"), acc.state.alias("entry"))))
            return F.struct(_through(acc.state, part.table).alias("state"), out.alias("out"))

        empty = F.array().cast("array<struct<s:bigint,entry:struct<off:int,cuts:bigint>>>")
        return F.aggregate(parts, F.struct(start.alias("state"), empty.alias("out")), step, lambda acc: acc.out)

    parts = F.array_sort(F.collect_list(F.struct("s", "table"))).alias("parts")
    if levels == 0:
        rows = tables.groupBy(*keys).agg(parts)
        return rows.select(*keys, F.inline(follow(F.col("parts"), _state(F.lit(0), F.lit(0)))))
    grouped = tables.withColumn("g", F.floor(F.col("s") / CUT_SLICE)).groupBy(*keys, "g").agg(parts)
    joined = _once(F.col("parts"), lambda p: _table(lambda e: F.aggregate(p, _state(e, F.lit(0)), lambda state, part: _through(state, part.table))))
    above = _entries(grouped.select(*keys, F.col("g").alias("s"), joined.alias("table")), keys, levels - 1)
    found = grouped.alias("l").join(
        above.withColumnRenamed("s", "g").alias("r"), scan.same_key([*keys, "g"])
    ).select("l.*", "r.entry")
    return found.select(*keys, F.inline(follow(F.col("parts"), F.col("entry"))))


def forced_cuts(
    segmented: DataFrame, doc: list[str], hot: int | bool | None = None, levels: int | None = None
) -> DataFrame:
    """Split segments that reach 60 paragraphs or 12 000 characters, in column ``cut`` (from 0).

    Where a cut falls depends on the cut before it, but never more than 60 paragraphs behind it.
    So a slice of 256 paragraphs is entered at one of 60 places, and a table of what leaves it for
    each of them stands for the slice; tables are followed in order, rows are not. Every slice then
    finds its own cuts. A segment of any length is so dealt over many tasks. Runs of contents lines
    stay whole; empty input gives no rows; null documents are one document.
    """
    keys = [*doc, "segment"]
    hot = scan.is_hot(segmented, doc) if hot is None else hot
    levels = (CUT_LEVELS if hot else 0) if levels is None else levels
    para = F.col("kind") == "paragraph"
    counted = scan.running_sum(segmented, keys, "ord", para.cast("long"), "_k", before=True, hot=hot)
    # the first paragraphs of a slice are seen from the slice before, too
    own = F.floor(F.col("_k") / CUT_SLICE)
    ahead = (F.col("_k") % CUT_SLICE < fixed.FORCE_CUT_PARAGRAPHS) & (own > 0)
    sizes = (
        counted.filter(para & ~F.col("is_toc"))
        .select(*keys, "_k", F.length("text").alias("size"), F.explode(F.when(ahead, F.array(own - 1, own)).otherwise(F.array(own))).alias("s"))
        .groupBy(*keys, "s").agg(F.array_sort(F.collect_list(F.struct("_k", "size"))).alias("_p"), F.sum("size").alias("_chars"))
        .filter((F.col("s") > 0) | (F.size("_p") >= fixed.FORCE_CUT_PARAGRAPHS) | (F.col("_chars") >= fixed.FORCE_CUT_CHARS))
        .select(*keys, "s", _hops(F.transform("_p", lambda p: p["size"]), F.col("s") == 0).alias("hops"))
    )

    def leaving(marks: Column) -> Column:
        last = F.element_at(marks, -1)
        return _state(F.when(last < 0, last).otherwise(last - CUT_SLICE), F.size(marks) - 1 - (last < 0).cast("int"))

    table = _once(F.col("hops"), lambda h: _table(lambda e: _walk(h, e, leaving)))
    entries = _entries(sizes.select(*keys, "s", table.alias("table")), keys, levels)
    marks = F.when(F.col("entry.off") < 0, F.array().cast("array<int>")).otherwise(_walk(F.col("hops"), F.col("entry.off")))
    # cuts before the slice, the one that enters it left out, as it is a mark of the slice
    base = F.col("entry.cuts") - (F.col("entry.off") >= 0).cast("long")
    cuts = sizes.alias("l").join(entries.alias("r"), scan.same_key([*keys, "s"])).select(
        *[f"l.{k}" for k in keys], "l.s", marks.alias("_marks"), base.alias("_base")
    )
    placed = counted.withColumn("s", F.floor(F.greatest(F.col("_k") - 1, F.lit(0)) / CUT_SLICE))
    place = F.col("_k") - F.col("s") * CUT_SLICE
    found = F.col("_base") + F.size(F.filter("_marks", lambda m: (m >= 0) & (m <= place)))
    return (
        placed.alias("l").join(cuts.alias("r"), scan.same_key([*keys, "s"]), "left").select("l.*", "r._marks", "r._base")
        .withColumn("cut", F.when(F.col("is_toc") | F.col("_base").isNull(), F.lit(0)).otherwise(found).cast("int"))
        .drop("_marks", "_base", "_k", "s")
    )


def _first_text(cond: Column) -> Column:
    return F.min_by(F.col("text"), F.when(cond, F.col("ord")))


def _start(text, most: int | None):
    """The text, or its first ``most`` characters."""
    return T.col(text) if most is None else F.substring(text, 1, most)


def document_blocks(
    elements: DataFrame, doc: list[str], tables_alone: bool = False, header_max: int | None = None, trail_max: int | None = None
) -> DataFrame:
    """Blocks with number, header and size.

    A lone heading without content becomes a breadcrumb of the next block; trailing ones
    form a last, empty block. Headers and trails are whole unless ``header_max`` and
    ``trail_max`` say how many characters to keep.
    """
    hot = scan.is_hot(elements, doc)
    cut = forced_cuts(segments(elements, doc, tables_alone, hot), doc, hot)
    para, section = F.col("kind") == "paragraph", _section(tables_alone)
    figure = F.col("text").rlike(fixed.FIGURE_LINE) | F.col("text").rlike(fixed.CONTINUED)
    raw = cut.groupBy(*doc, "segment", "cut").agg(
        F.min("ord").alias("start"),
        F.count_if(para).alias("paragraphs"),
        F.sum(F.when(para, F.length("text")).otherwise(0)).alias("chars"),
        F.max(~para).alias("has_table"),
        F.max("is_toc").alias("is_toc"),
        F.max(
            para & (F.col("is_heading") | F.col("text").rlike(section) | F.col("text").rlike(fixed.CAPTION))
        ).alias("_headed"),
        _first_text(para & F.col("is_heading") & ~figure).alias("_heading"),
        _first_text(para & F.col("text").rlike(fixed.CAPTION)).alias("_caption"),
        _first_text(~para & (F.col("text") != "")).alias("_table"),
        _first_text(para & ~figure).alias("_plain"),
        _first_text(para).alias("_only"),
        _first_text(para & (F.col("text").rlike(section) | F.col("text").rlike(fixed.CAPTION))).alias("_numbered"),
    )
    if tables_alone:
        orphan = F.lit(False)
    else:
        orphan = (F.col("paragraphs") == 1) & ~F.col("has_table") & ~F.col("is_toc") & F.col("_headed")
    marked = raw.withColumn("_orphan", orphan)
    numbered = scan.running_sum(
        marked, doc, "start", (~F.col("_orphan")).cast("long"), "block_num", hot=hot
    )
    crumbs = numbered.filter("_orphan").groupBy(*doc, "block_num").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("start", _start("_only", header_max).alias("t")))),
            lambda x: x.t,
        ).alias("_crumbs"),
        F.min("start").alias("_crumb_start"),
    ).withColumn("block_num", F.col("block_num") + 1)
    blocks = numbered.filter(~F.col("_orphan")).join(crumbs, [*doc, "block_num"], "full_outer")
    none = F.array().cast("array<string>")
    trail = F.coalesce("_crumbs", none)
    dangling = F.col("start").isNull()
    if tables_alone:
        short = (F.length("_only") < fixed.HEADER_MAX) & ~F.col("_only").rlike(fixed.FIGURE_LINE)
        candidates = ["_numbered", F.when(short, F.col("_only")), "_table", "_plain"]
    else:
        candidates = ["_heading", "_caption", "_table", "_plain"]
    own = (
        F.when(dangling, F.element_at(trail, -1))
        .when(F.col("is_toc"), F.lit("(목차)"))
        .otherwise(
            F.coalesce(
                *[_start(c, header_max) for c in candidates],
                F.concat(F.lit("(블록 "), F.col("block_num").cast("string"), F.lit(")")),
            )
        )
    )
    path = F.when(dangling, F.slice(trail, 1, F.greatest(F.size(trail) - 1, F.lit(0)))).otherwise(trail)
    header = F.when(F.size(path) > 0, _start(F.array_join(F.concat(path, F.array(own)), " > "), trail_max)).otherwise(own)
    return blocks.select(
        *doc, "block_num",
        F.when(F.coalesce(F.col("cut"), F.lit(0)) > 0, F.concat(header, F.lit(" (계속)"))).otherwise(header).alias("header_text"),
        F.coalesce("paragraphs", F.lit(0)).alias("paragraphs"),
        F.coalesce("chars", F.lit(0)).alias("chars"),
        F.coalesce("has_table", F.lit(False)).alias("has_table"),
        F.coalesce("is_toc", F.lit(False)).alias("is_toc"),
        "segment", "cut",
    )


def _matches(pattern: str):
    return lambda x: x.rlike(pattern)


def source_text(header, paragraphs, table, ends: tuple[int, int] | None = None) -> Column:
    """Header, label hint, paragraphs and table of one block, whole unless ``ends`` gives how many
    characters of the start and the end to keep of a longer text.

    ``paragraphs`` is ARRAY<STRING> and bounded by the forced cut.
    """
    h, p, t = T.col(header), T.col(paragraphs), T.col(table)
    found = F.filter(
        F.array(
            *[F.when(F.exists(p, _matches(rx)), F.lit(name)) for name, rx in LABELS.items()]
        ),
        lambda x: x.isNotNull(),
    )
    filled = F.size(p) > 0
    whole = F.concat_ws(
        "\n\n",
        F.concat(F.lit("[HEADER] "), F.coalesce(h, F.lit(""))),
        F.when(filled & (F.size(found) > 0), F.concat(F.lit("[LABEL_PATTERNS_DETECTED] "), F.array_join(found, " "))),
        F.when(filled, F.lit("[PARAGRAPHS]")),
        F.when(filled, F.array_join(p, "\n")),
        F.when(T.blank_to_null(t).isNotNull(), F.concat(F.lit("[TABLE]\n\n"), t)),
    )
    if ends is None:
        return whole
    head, tail = ends
    return F.when(F.length(whole) <= head + tail, whole).otherwise(
        F.concat(F.substring(whole, 1, head), F.lit(fixed.CUT_MARK), F.right(whole, F.lit(tail)))
    )


# --- tables --------------------------------------------------------------------------


def html_cells(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """Cells of every table in a page: table number, row, place in the row, text and spans."""
    inside = lambda tag: r"(?is)<" + tag + r"\b[^>]*>(.*?)</" + tag + r"\s*>"
    tables = pages.select(
        *keys, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(inside("table")), F.lit(1))).alias("table_no", "_t")
    )
    rows = tables.select(
        *keys, "table_no", F.posexplode(F.regexp_extract_all("_t", F.lit(inside("tr")), F.lit(1))).alias("row", "_r")
    )
    cell = r"(?is)<t[dh]\b([^>]*)>(.*?)</t[dh]\s*>"
    zipped = F.arrays_zip(
        F.regexp_extract_all("_r", F.lit(cell), F.lit(1)).alias("a"),
        F.regexp_extract_all("_r", F.lit(cell), F.lit(2)).alias("b"),
    )
    cells = rows.select(*keys, "table_no", "row", F.posexplode_outer(zipped).alias("seq", "z"))

    def span(name: str) -> Column:
        raw = F.regexp_extract(F.col("z.a"), r"(?i)" + name + r"\s*=\s*[\"']?\s*(\d+)", 1).try_cast("int")
        stated = F.greatest(F.coalesce(raw, F.lit(1)), F.lit(1))
        return F.when(F.contains(F.col("z.a"), F.lit("=")), stated).otherwise(F.lit(1)).alias(name)

    text = F.regexp_replace(F.col("z.b"), r"(?i)<(br|p|div|li)\b[^>]*>", " ")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#124;", "|"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    # most cells hold neither markup nor references
    text = F.when(F.contains(F.col("z.b"), F.lit("<")) | F.contains(F.col("z.b"), F.lit("&")), text).otherwise(F.col("z.b"))
    return cells.select(*keys, "table_no", "row", "seq", T.squeeze(text).alias("text"), span("rowspan"), span("colspan"))


#: Rows that a fold holds before it hands them on as one block.
FOLDED = 128


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row, not once an element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def cell_grid(cells: DataFrame, table: list[str], max_colspan: int | None = None) -> DataFrame:
    """Dense grid of every table: a cell repeats across its column span and is blank below, along
    its row span; the cells of a row take the columns that spans from above leave free. A row ends before
    its first empty column; a span beyond it waits for a row that reaches it.

    The rows of a table are folded in the JVM; what a row hands on is the columns still spanned. Rows
    are folded in blocks, so the work grows with their number. ``max_colspan`` bounds column spans (1000
    in the HTML standard); by default they are whole. The cells of one table come from one page, so an
    array per table is bounded by it.
    """
    width = F.col("colspan") if max_colspan is None else F.least("colspan", F.lit(max_colspan))
    own = F.when(F.col("seq").isNotNull(), F.struct("seq", "text", "rowspan", width.alias("colspan")))
    by_row = cells.groupBy(*table, F.col("row").cast("int").alias("row")).agg(F.array_sort(F.collect_list(own)).alias("_own"))
    packed = by_row.groupBy(*table).agg(F.array_sort(F.collect_list(F.struct("row", "_own"))).alias("_rows"))
    kind = "array<struct<row:int,placed:array<struct<col:int,text:string,rowspan:int>>,spanned:array<struct<col:int,left:int>>,until:int>>"

    def one_row(done: Column, line: Column) -> Column:
        above = F.try_element_at(done, F.lit(-1))
        going_on = F.transform(above["spanned"], lambda s: F.struct(s["col"].alias("col"), (s["left"] - (s["col"] < above["until"]).cast("int")).alias("left")))
        begun = F.transform(above["placed"], lambda p: F.struct(p["col"].alias("col"), (p["rowspan"] - 1).alias("left")))
        spanned = F.coalesce(
            F.filter(F.concat(going_on, begun), lambda s: s["left"] > 0), F.array().cast("array<struct<col:int,left:int>>")
        )
        units = F.coalesce(
            F.flatten(F.transform(line["_own"], lambda c: F.array_repeat(F.struct(c["text"].alias("text"), c["rowspan"].cast("int").alias("rowspan")), c["colspan"]))),
            F.array().cast("array<struct<text:string,rowspan:int>>"),
        )

        def place(units: Column, spanned: Column, free: Column) -> Column:
            placed = F.zip_with(
                units, F.slice(free, F.lit(1), F.size(units)),
                lambda u, c: F.struct(c.alias("col"), u["text"].alias("text"), u["rowspan"].alias("rowspan")),
            )
            return F.struct(line["row"].alias("row"), placed.alias("placed"), spanned.alias("spanned"), F.get(free, F.size(units)).alias("until"))

        def with_free(units: Column, spanned: Column) -> Column:
            taken = F.transform(spanned, lambda s: s["col"])
            free = F.array_except(F.sequence(F.lit(0), F.size(units) + F.size(spanned)), taken)
            return _let(free, lambda f: place(units, spanned, f))

        # only the new row is bound: what a binding holds is copied
        return F.concat(done, F.array(_let(units, lambda u: _let(spanned, lambda s: with_free(u, s)))))

    def one_block(blocks: Column, lines: Column) -> Column:
        """The fold of some rows, begun with the last row before them."""
        last = F.slice(F.coalesce(F.try_element_at(blocks, F.lit(-1)), F.array().cast(kind)), F.lit(-1), F.lit(1))
        return F.concat(blocks, F.array(F.aggregate(lines, F.when(F.size(blocks) > 0, last).otherwise(F.array().cast(kind)), one_row)))

    def own_rows(blocks: Column) -> Column:
        return F.flatten(F.transform(blocks, lambda b, i: F.when(i == 0, b).otherwise(F.slice(b, F.lit(2), F.size(b)))))

    def every_row(rows: Column) -> Column:
        """Rows without a cell of their own are there as well, from row 0 on."""
        none = F.element_at(rows, 1)["_own"]

        def with_gap(r: Column, i: Column) -> Column:
            first = F.coalesce(F.get(rows, i - 1)["row"], F.lit(-1)) + 1
            gap = F.when(first < r["row"], F.transform(F.sequence(first, r["row"] - 1), lambda n: F.struct(n.alias("row"), F.slice(none, 1, 0).alias("_own"))))
            return F.when(gap.isNull(), F.array(r)).otherwise(F.concat(gap, F.array(r)))

        return F.flatten(F.transform(rows, with_gap))

    def in_blocks(rows: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(rows), F.lit(FOLDED))
        return F.transform(starts, lambda at: F.slice(rows, at, F.lit(FOLDED)))

    blocks = _let(every_row(F.col("_rows")), in_blocks)
    folded = packed.select(*table, F.explode(F.aggregate(blocks, F.array().cast(f"array<{kind}>"), one_block, own_rows)).alias("_r"))
    blank = F.transform(F.filter("_r.spanned", lambda s: s["col"] < F.col("_r.until")), lambda s: F.struct(s["col"].alias("col"), F.lit("").alias("text"), F.lit(1).alias("rowspan")))
    return folded.select(*table, F.col("_r.row").alias("row"), F.explode(F.concat("_r.placed", blank)).alias("_c")).select(
        *table, "row", "_c.*"
    )


def merge_list(grid: DataFrame, table: list[str]) -> DataFrame:
    """Vertical merges of a grid."""
    return grid.filter(F.col("rowspan") > 1).select(
        *table, "row", "col", F.col("rowspan").alias("merged_rows"), F.col("text").alias("value")
    )


def grid_lines(grid: DataFrame, table: list[str]) -> DataFrame:
    """Every grid row as one pipe-separated line."""
    return grid.groupBy(*table, "row").agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("col", T.cell_text("text").alias("t")))), lambda x: x.t
            ),
            " | ",
        ).alias("line")
    )
