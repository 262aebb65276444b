"""Rules over logical lines and indented blocks of Python files.

The lines are counted, and one shuffle spreads the files over tasks of a bounded number of lines;
every later window and grouping over lines reuses that partitioning. All steps are linear in the size of a file: a block is closed by the
first line that drops to its indent, so each drop is sent to the levels it closes and one
window per level finds the end. No join compares lines with lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesieve.operators.catalog import BLOCK_RULES
from codesieve.operators.units import file_keys
from codesieve.schemas import ISSUE_COLUMNS
from codesieve.settings import MAX_FUNCTION_SPAN, MAX_PARAMETERS

# Tokens of Python text, strings and comments first. Repeats are possessive.
PY_TOKENS = (
    r'"""(?:[^"\\]++|\\.|"(?!""))*+"""',
    r"'''(?:[^'\\]++|\\.|'(?!''))*+'''",
    r'"(?:[^"\\\n]++|\\.)*+"',
    r"'(?:[^'\\\n]++|\\.)*+'",
    r"#[^\n]*+",
    r"""[^"'#]++""",
    r".",
)
PY_TOKEN = "(?s)" + "|".join(PY_TOKENS)
CALL = r"(?<![\p{L}\p{N}_.])(?<!def )(eval|exec)\s*\("
FUNCTION = r"^\s*def\s+([\p{L}\p{N}_]+)\s*(?:\[[^\]]*\])?\s*\("
LOOP = r"^\s*(?:for|while)(?![\p{L}\p{N}_])"
BARE_EXCEPT = r"^\s*except\s*:"
ELSE = r"^\s*else\s*:"
DEF, LOOPING, EXCEPT = 1, 2, 3
#: A task takes about as many lines at most, and while there are idle cores it gets no fewer than the second.
LINES_PER_TASK, LEAST_LINES = 16_384, 1_024
#: Characters that weigh as much as a line.
LINE_CHARS = 128


def masked_text(content: Column) -> Column:
    """Text with comments dropped and each string reduced to its quotes and newlines."""
    tokens = F.regexp_extract_all(content, F.lit(PY_TOKEN), F.lit(0))

    def mask(token: Column) -> Column:
        string = F.concat(F.lit('"'), F.regexp_replace(token, r"[^\n]+", ""), F.lit('"'))
        quoted = (F.length(token) > 1) & token.rlike("^[\"']")
        return F.when(F.startswith(token, F.lit("#")), "").when(quoted, string).otherwise(token)

    return F.array_join(F.transform(tokens, mask), "")


def _line_tasks(rows: DataFrame) -> int:
    """Number of tasks for the lines of ``rows``, from a count of them.

    Files are small where they are shuffled and many times larger as the rows the windows sort, so tasks
    merged by the bytes of the shuffle would hold more lines the more files there are.
    """
    content = F.col("content")
    weight = F.regexp_count(content, F.lit("\n")) + 1 + F.floor(F.length(content) / LINE_CHARS)
    lines = rows.agg(F.sum(weight)).first()[0] or 0
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-lines // LINES_PER_TASK), min(cores, -(-lines // LEAST_LINES)))


def _python_lines(files: DataFrame, keys: list[str], spread: bool) -> DataFrame:
    raw, masked = F.split("content", "\n"), F.split(masked_text(F.col("content")), "\n")
    rows = files.where((F.col("language") == "python") & (F.col("content") != "")).select(*keys, "content")
    # Files are brought to their tasks whole: the shuffle has a row per file, and the windows over
    # its lines need no other.
    return (
        (rows.repartition(_line_tasks(rows), *keys) if spread else rows)
        .select(*keys, F.posexplode(F.arrays_zip(raw.alias("raw"), masked.alias("masked"))))
        .select(*keys, (F.col("pos") + 1).alias("line_no"), "col.raw", "col.masked")
    )


def logical_lines(files: DataFrame, spread: bool = True) -> DataFrame:
    """One row per statement line: its number ``k``, first and last physical line, indent,
    kind of header, signature if it is a function, number of ``+=`` and its eval/exec calls."""
    keys = file_keys(files)
    masked = F.col("masked")
    calls = F.when(F.contains(masked, F.lit("eval")) | F.contains(masked, F.lit("exec")),
                   F.regexp_extract_all(masked, F.lit(CALL), F.lit(1)))
    # Raw text goes along only where an issue may show it: the shuffle carries half as much.
    shown = masked.rlike(r"\+=|\b(?:eval|exec|def|except)\b")
    lines = _python_lines(files, keys, spread).withColumns({
        "raw": F.when(shown, F.col("raw")),
        "balance": F.regexp_count(masked, F.lit(r"[(\[{]")) - F.regexp_count(masked, F.lit(r"[)\]}]")),
        "quotes": F.regexp_count(masked, F.lit('"')),
        "blank": ~masked.rlike(r"[^ \t\f\r]"),
        "glued": F.endswith(masked, F.lit("\\")),
    })
    ordered = Window.partitionBy(*keys).orderBy("line_no")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    first = (
        ~F.col("blank")
        & (F.coalesce(F.sum("balance").over(before), F.lit(0)) == 0)
        & (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 0)
        & ~F.coalesce(F.lag("glued").over(ordered), F.lit(False))
    )
    numbered = lines.withColumn("first", first).withColumns({
        "k": F.sum(F.col("first").cast("int")).over(ordered),
        "in_def": F.last(F.when(F.col("first"), masked.rlike(FUNCTION)), ignorenulls=True).over(ordered),
    }).where(~F.col("blank") & (F.col("k") > 0)).withColumn("calls", calls)
    at_first = lambda column: F.max(F.when(F.col("first"), column))
    part = F.struct("line_no", "raw", "calls", (F.col("balance") > 0).alias("open"),
                    F.when(F.col("in_def"), masked).alias("masked"))
    wanted = F.col("in_def") | (F.col("first") & F.col("raw").isNotNull()) | (F.size("calls") > 0)
    parts = F.array_sort(F.col("parts"))
    return (
        numbered.groupBy(*keys, "k")
        .agg(
            F.min("line_no").alias("line_start"),
            F.max("line_no").alias("line_end"),
            at_first(F.length(F.regexp_replace(
                F.regexp_extract(masked, r"^[ \t]*", 0), "\t", " " * 8))).alias("indent"),
            at_first(F.when(F.col("in_def"), DEF).when(masked.rlike(LOOP), LOOPING)
                     .when(masked.rlike(BARE_EXCEPT), EXCEPT)).alias("kind"),
            F.max(F.col("first") & masked.rlike(ELSE)).alias("is_else"),
            F.sum(F.regexp_count(masked, F.lit(r"\+="))).alias("augments"),
            F.collect_list(F.when(wanted, part)).alias("parts"),
        )
        .withColumn("parts", parts)
        .withColumns({
            "raw": F.get("parts", F.lit(0))["raw"],
            "statement": F.when(F.col("kind") == DEF, F.array_join(F.col("parts.masked"), "\n")),
            "calls": F.filter("parts", lambda p: F.size(p["calls"]) > 0),
        }).drop("parts")
    )


def _parameters(statement: str) -> Column:
    """Signature split on its own commas, with each bracket reduced to a mark: ``@L`` for a list,
    ``@D`` for a dict or set, ``@P`` for others, comprehensions included.

    One fold over the brackets, commas and the text between them, so any depth is one pass. A
    comma between ``lambda`` and its colon belongs to the lambda.
    """
    signature = F.regexp_replace(statement, FUNCTION, "")
    tokens = F.regexp_extract_all(signature, F.lit(r"[(\[{)\]},]|[^()\[\]{},]+"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("done"), F.lit("").alias("opener"),
                     F.lit(False).alias("loop"), F.lit("").alias("text"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, t: Column) -> Column:
        opens, closes, top = t.isin("(", "[", "{"), t.isin(")", "]", "}"), s["depth"] == 0
        splits = top & (t == ",") & ~s["text"].rlike(r"(?<![\p{L}\p{N}_])lambda(?![\p{L}\p{N}_])[^:]*$")
        ends = top & closes
        back = (s["depth"] == 1) & closes
        mark = F.when((s["opener"] == "[") & ~s["loop"], "@L").when(
            (s["opener"] == "{") & ~s["loop"], "@D").otherwise("@P")
        text = F.when(splits | ends, "").when(back, F.concat(s["text"], mark)).when(
            top & ~opens, F.concat(s["text"], t)).otherwise(s["text"])
        loop = F.when(top, False).otherwise(
            s["loop"] | ((s["depth"] == 1) & t.rlike(r"(?<![\p{L}\p{N}_])for(?![\p{L}\p{N}_])")))
        moved = F.struct(
            (s["depth"] + opens.cast("int") - (closes & ~top).cast("int")).alias("depth"), ends.alias("done"),
            F.when(top & opens, t).otherwise(s["opener"]).alias("opener"), loop.alias("loop"), text.alias("text"),
            F.when(splits | ends, F.array_append(s["parts"], s["text"])).otherwise(s["parts"]).alias("parts"))
        return F.when(s["done"], s).otherwise(moved)

    parts = F.transform(F.aggregate(tokens, start, step)["parts"], lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda p: p != "")


def _positional(names: Column) -> Column:
    """Parameters before the first ``*``."""
    starred = F.filter(names, lambda p: F.startswith(p, F.lit("*")))
    first = F.array_position(names, F.get(starred, F.lit(0)))
    return F.slice(names, 1, F.coalesce(first - 1, F.size(names)).cast("int"))


def _blocks(statements: DataFrame, keys: list[str]) -> DataFrame:
    """Headers with the last line of their block, and lines with calls or ``+=``."""
    ordered = Window.partitionBy(*keys).orderBy("k")
    whole = Window.partitionBy(*keys)
    indent = F.col("indent")
    placed = statements.withColumns({
        "next_indent": F.lead("indent").over(ordered),
        "next_else": F.lead("is_else").over(ordered),
        "prev_indent": F.lag("indent").over(ordered),
        "prev_else": F.lag("is_else").over(ordered),
        "prev_end": F.lag("line_end").over(ordered),
        "last_k": F.max("k").over(whole),
        "last_end": F.max("line_end").over(whole),
        "levels": F.array_sort(F.collect_set(F.when(F.col("kind").isNotNull(), indent)).over(whole)),
    })
    # The levels a line closes: those it drops through, and the level of an empty ``else``.
    drops = F.filter("levels", lambda level: (level >= indent) & (
        (level < F.col("prev_indent")) | (F.col("prev_else") & (level == F.col("prev_indent")))))
    passes_else = F.col("next_else") & (F.col("next_indent") == indent) & (F.col("kind") == LOOPING)
    empty = F.col("next_indent").isNull() | ((F.col("next_indent") <= indent) & ~passes_else)
    nothing = F.lit(None).cast("int")

    def event(what: str, level: Column, **extra: Column) -> Column:
        fields = {"closes_any": F.lit(False), "closes_loop": F.lit(False), "close_k": nothing,
                  "close_end": nothing} | extra
        return F.struct(F.lit(what).alias("what"), level.cast("int").alias("level"),
                        *[v.alias(n) for n, v in fields.items()])

    closers = F.transform(drops, lambda level: event(
        "close", level, closes_any=F.lit(True),
        closes_loop=~(F.col("is_else") & (level == indent)),
        close_k=F.col("k").cast("int"), close_end=F.col("prev_end").cast("int")))
    own = F.array_compact(F.array(
        F.when(F.col("kind").isNotNull(), event("open", indent)),
        F.when((F.size("calls") > 0) | (F.col("augments") > 0), event("line", F.lit(-1)))))
    events = placed.withColumn("empty", empty).select(
        *keys, "k", "kind", "line_start", "line_end", "raw", "statement", "augments", "calls",
        "empty", "last_k", "last_end", F.inline(F.concat(closers, own))).withColumns({
            # Texts go along with a line's own events, once.
            c: F.when(F.col("what") != "close", F.col(c)) for c in ("raw", "statement", "calls")})
    # Read backwards, the last closing seen before a header is the first one after it. At
    # equal k the header comes first, as a line cannot close its own block.
    backwards = (Window.partitionBy(*keys, "level")
                 .orderBy(F.desc("k"), F.when(F.col("what") == "close", 1).otherwise(0))
                 .rowsBetween(Window.unboundedPreceding, 0))
    close = F.struct("close_k", "close_end")
    ended = events.withColumns({
        "any_close": F.last(F.when(F.col("closes_any"), close), ignorenulls=True).over(backwards),
        "loop_close": F.last(F.when(F.col("closes_loop"), close), ignorenulls=True).over(backwards),
    }).where(F.col("what") != "close")
    chosen = F.when(F.col("kind") == LOOPING, F.col("loop_close")).otherwise(F.col("any_close"))
    return ended.withColumn("close", chosen).withColumns({
        "block_k": F.when(F.col("empty"), F.col("k"))
                    .otherwise(F.coalesce(F.col("close.close_k") - 1, F.col("last_k"))),
        "block_end": F.when(F.col("empty"), F.col("line_end"))
                      .otherwise(F.coalesce(F.col("close.close_end"), F.col("last_end"))),
    })


def _with_loop_depth(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Number of loops around each line: +1 where a loop starts, -1 after it ends. The loop's
    own line counts, as in ``for x in y: s += x``."""
    is_loop = (F.col("what") == "open") & (F.col("kind") == LOOPING)
    marks = F.when(is_loop, F.array(
        F.struct(F.col("k").alias("at"), F.lit(1).alias("delta")),
        F.struct((F.col("block_k") + 1).alias("at"), F.lit(-1).alias("delta")),
    )).otherwise(F.array(F.struct(F.col("k").alias("at"), F.lit(0).alias("delta"))))
    # The default frame of an ordered window includes rows with an equal key.
    ordered = Window.partitionBy(*keys).orderBy("at")
    return (blocks.select("*", F.inline(marks))
            .withColumn("depth", F.sum("delta").over(ordered))
            .where(~is_loop))


def block_units(files: DataFrame) -> DataFrame:
    """Python blocks as units of scope ``block`` for rules of a user: ``kind`` (function, loop or
    except), ``name`` of a function, ``text`` of the header's first line, ``line_no`` and ``line_end``, and
    ``body``, the lines from the header to the end with comments dropped and strings emptied."""
    keys = file_keys(files)
    kinds = {DEF: "function", LOOPING: "loop", EXCEPT: "except"}
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), F.col("kind"))
    blocks = _blocks(logical_lines(files), keys).where(F.col("what") == "open").select(
        *keys, kind.alias("kind"), F.regexp_extract("statement", FUNCTION, 1).alias("name"),
        F.col("line_start").cast("int").alias("line_no"), F.col("block_end").cast("int").alias("line_end"))
    texts = files.where((F.col("language") == "python") & (F.col("content") != "")).select(
        *keys, F.split("content", "\n").alias("raw"), F.split(masked_text(F.col("content")), "\n").alias("masked"))
    first = F.col("line_no")
    return blocks.join(texts, keys).select(
        *keys, F.lit("python").alias("language"), F.lit("block").alias("scope"), "line_no", "line_end", "kind", "name",
        F.get("raw", first - 1).alias("text"), F.slice("masked", first, F.col("line_end") - first + 1).alias("body"))


def block_findings(files: DataFrame, spread: bool = True) -> DataFrame:
    """Lines with findings of the block rules: the text once, and ``found``, an array of them.
    ``spread=False`` is for files that lie in buckets by their key and need not be moved."""
    keys = file_keys(files)
    rules = {r.rule_id: r for r in BLOCK_RULES}
    rows = _with_loop_depth(_blocks(logical_lines(files, spread), keys), keys)
    name = F.regexp_extract("statement", FUNCTION, 1)
    is_def = (F.col("what") == "open") & (F.col("kind") == DEF)
    rows = rows.withColumns({
        "name": F.when(is_def, name), "names": F.when(is_def, _parameters("statement")),
    }).withColumn("params", _positional(F.col("names")))
    slash = F.array_position("params", "/").cast("int")
    defaults = F.size(F.filter("params", lambda p: p.rlike(r"=\s*@[LD]$")))
    width = F.size("params") - F.coalesce(slash, F.lit(0))
    span = F.col("block_end") - F.col("line_start")

    def hit(rule_id: str, details: tuple = (), start="line_start", end="line_start",
            recommendation: Column | None = None, copies: Column | None = None) -> Column:
        rule = rules[rule_id]
        text = F.lit(rule.description) if not details else F.format_string(
            rule.description.replace("{}", "%s"), *details)
        as_column = lambda c: F.col(c) if isinstance(c, str) else c
        return F.struct(
            F.lit(rule_id).alias("rule_id"), F.lit(rule.category).alias("category"),
            F.lit(rule.severity).alias("severity"), text.alias("description"),
            (F.lit(rule.recommendation) if recommendation is None else recommendation)
            .alias("recommendation"),
            as_column(start).cast("int").alias("line_start"),
            as_column(end).cast("int").alias("line_end"),
            (F.lit(1) if copies is None else F.coalesce(copies, F.lit(0))).cast("int").alias("copies"))

    def line(text: str | Column, hits: Column) -> Column:
        found = F.filter(hits, lambda h: h["copies"] > 0)
        return F.struct((F.col(text) if isinstance(text, str) else text).alias("code_snippet"), found.alias("found"))

    calls = F.transform("calls", lambda call: line(call["raw"], F.transform(call["calls"], lambda called: hit(
        "PY-03", (called,), start=call["line_no"],
        end=F.when(call["open"], F.col("line_end")).otherwise(call["line_no"]),
        recommendation=F.concat(F.lit("Avoid using "), called, F.lit("()."))))))
    lines = F.when(F.col("what") == "line", F.concat(calls, F.array(line("raw", F.array(
        hit("PY-08", end="line_end", copies=F.col("augments") * F.col("depth"))))),
    )).when(is_def, F.array(line("raw", F.array(
        hit("PY-05", ("name",), copies=defaults),
        hit("PY-06", ("name", span), end="block_end", copies=(span > MAX_FUNCTION_SPAN).cast("int")),
        hit("PY-07", ("name", width), copies=(width > MAX_PARAMETERS).cast("int")),
    )))).when(F.col("kind") == EXCEPT, F.array(line("raw", F.array(hit("PY-04", end="block_end")))))
    return rows.select(*keys, F.inline(lines)).where(F.size("found") > 0)


def block_issues_of(rows: DataFrame, *texts: str) -> DataFrame:
    """One row per finding; ``texts`` are the columns that stand for the text.

    Equal issues are repeated after the array is opened: a statement deep in loops may have many,
    and as numbers they are small.
    """
    keys = file_keys(rows)
    issues = rows.select(*keys, *texts, F.inline("found")).withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return issues.select(*keys, *[c for c in ISSUE_COLUMNS if c not in (*keys, "code_snippet")], *texts)


def python_block_issues(files: DataFrame, spread: bool = True) -> DataFrame:
    """Issues of the block rules: dangerous calls, bare handlers, mutable defaults, long and
    wide functions, ``+=`` in loops. ``+=`` is reported once per loop around it."""
    return block_issues_of(block_findings(files, spread), "code_snippet")
