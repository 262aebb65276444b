"""Review requests and answers as tables: batches, prompts, parsed and normalised issues.

No service is called. The tables hold what was sent and what came back.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesieve.settings import BATCH_FILES, BATCH_TOKENS, CATEGORIES, SEVERITIES

ANSWER_ISSUE = (
    "struct<category: string, severity: string, line_start: int, line_end: int, "
    "description: string, recommendation: string>"
)
ANSWER_FIELDS = tuple(f.split(":")[0] for f in ANSWER_ISSUE[7:-1].split(", "))

# Request texts.
SINGLE_PROMPT = """You are an expert code reviewer. Analyze the following {language} code and identify issues.

File: {file_path}

Code:
```{language}
{content}
```

Please identify issues in the following categories:
1. Security vulnerabilities (SQL injection, XSS, hardcoded secrets, etc.)
2. Bugs and logic errors
3. Performance issues
4. Maintainability and code quality issues

For each issue, provide:
- Category (security, bug, performance, or maintainability)
- Severity (error, warning, or info)
- Line number(s) where the issue occurs
- Clear description of the issue
- Recommendation for fixing it

Format your response as a JSON array of issues:
[
  {{
    "category": "security",
    "severity": "error",
    "line_start": 10,
    "line_end": 10,
    "description": "Hardcoded API key detected",
    "recommendation": "Move API key to environment variables"
  }}
]

If no issues are found, return an empty array: []
"""
BATCH_HEAD = (
    "You are an expert code reviewer. Analyze the following code files and identify issues in each."
    "\n\nFiles to analyze:\n"
)
BATCH_FILE = "\n--- File {number}: {file_path} ({language}) ---\n```{language}\n{content}\n```\n"
BATCH_TAIL = """
For EACH file, identify issues in these categories:
1. Security vulnerabilities (SQL injection, XSS, hardcoded secrets, etc.)
2. Bugs and logic errors
3. Performance issues
4. Maintainability and code quality issues

Format your response as a JSON object where keys are file paths and values are arrays of issues:
{
  "file1.py": [
    {
      "category": "security",
      "severity": "error",
      "line_start": 10,
      "line_end": 10,
      "description": "Hardcoded API key detected",
      "recommendation": "Move API key to environment variables"
    }
  ],
  "file2.js": []
}

If a file has no issues, use an empty array.
"""


def _filled(template: str, **values: Column) -> Column:
    """``template`` with its ``{name}`` parts replaced by columns; ``{{`` is a plain brace."""
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        parts += [F.lit(literal)] if literal else []
        parts += [values[name]] if name else []
    return F.concat(*parts)


def single_prompt(file_path: Column, language: Column, content: Column) -> Column:
    return _filled(SINGLE_PROMPT, file_path=file_path, language=language, content=content)


# --- batching -----------------------------------------------------------------------
# A batch takes files in order while it has fewer than ``max_files`` and stays within
# ``max_tokens``. One pass over a whole repository would put it into one task. Instead the files lie
# in blocks of BLOCK_FILES. Whatever batch is open at the start of a block, the first fresh batch in
# it starts at one of its first ``max_files`` rows. So a block is a map from that row to the one of
# the next block. These maps are composed inside superblocks and then over superblocks, and the
# block each pass really entered is read off on the way back.

BLOCK_FILES, SUPERBLOCK = 512, 256
MOST_IN_BLOCK = 1 << 20


def _joined(state: Column, file: Column, max_files: int, max_tokens: int) -> dict[str, Column]:
    """The open batch after one more file, and the number of batches so far."""
    tokens = file["tokens"].cast("long")
    opens = (state["files"] == 0) | (state["files"] >= max_files) | (
        state["tokens"] + tokens > max_tokens)
    return {
        "number": state["number"] + opens.cast("long"),
        "files": F.when(opens, 1).otherwise(state["files"] + 1).cast("long"),
        "tokens": F.when(opens, tokens).otherwise(state["tokens"] + tokens),
    }


def _struct(**fields: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def _fold(files: Column, start: int, max_files: int, max_tokens: int) -> Column:
    """Batches opened and the one left open by the files from ``start`` on."""
    none = F.lit(0).cast("long")

    def step(state: Column, file: Column) -> Column:
        return _struct(**_joined(state, file, max_files, max_tokens))

    rest = F.slice(files, start + 1, F.greatest(F.size(files) - start, F.lit(0)))
    return F.aggregate(rest, _struct(number=none, files=none, tokens=none), step)


def _entered(open_batch: Column, heads: Column, max_files: int, max_tokens: int) -> Column:
    """How many of the first files of a block the open batch still takes."""
    def step(state: Column, tokens: Column) -> Column:
        fits = state["open"] & (open_batch["files"] + state["taken"] < max_files) & (
            state["used"] + tokens <= max_tokens)
        return _struct(taken=state["taken"] + fits.cast("int"), used=state["used"] + F.when(fits, tokens).otherwise(0),
                       open=fits)

    start = _struct(taken=F.lit(0), used=open_batch["tokens"], open=open_batch["files"] > 0)
    return F.aggregate(heads, start, step)["taken"]


def _numbered(files: DataFrame, group: str, block: str, order: str) -> DataFrame:
    """Files with ``part``, the number of the BLOCK_FILES files of their group they are among."""
    counts = files.groupBy(group, block).agg(F.count(F.lit(1)).alias("n"))
    # One row per block.
    along = Window.partitionBy(group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    bounded = F.when(F.col("n") > MOST_IN_BLOCK, F.raise_error(F.lit("a block of more files than a task should hold")))
    starts = counts.select(
        F.col(group).alias("in_group"), F.col(block).alias("in_block"),
        F.coalesce(bounded.cast("long"), F.sum("n").over(along), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy(group, block).orderBy(order)) - 1
    same = F.col(group).eqNullSafe(F.col("in_group")) & F.col(block).eqNullSafe(F.col("in_block"))
    return files.withColumn("within", within).join(starts, same).withColumn(
        "part", F.floor((F.col("start") + F.col("within")) / BLOCK_FILES)).select(*files.columns, "part")


def _entry_rows(shapes: DataFrame, group: str, max_files: int, max_tokens: int) -> DataFrame:
    """(entry_group, entry_part, skip, before): for each part the files the open batch takes from it
    and the batches opened before it. ``shapes`` has ends and heads per part."""
    previous = shapes.select(F.col(group).alias("p_group"), (F.col("part") + 1).alias("p_part"),
                             F.col("ends").alias("p_ends"))
    linked = shapes.join(previous, F.col(group).eqNullSafe(F.col("p_group")) & (F.col("part") == F.col("p_part")), "left")
    # From the row the previous part was entered at to the row this one is, and what was opened there.
    into = F.transform("p_ends", lambda e: _struct(
        skip=_entered(e, F.col("heads"), max_files, max_tokens), opened=e["number"]))
    first = F.array(*[_struct(skip=F.lit(0), opened=F.lit(0).cast("long")) for _ in range(max_files)])
    links = linked.select(F.col(group).alias("g"), F.floor(F.col("part") / SUPERBLOCK).alias("super"), F.struct(
        F.col("part").alias("part"), F.coalesce(into, first).alias("into")).alias("link"))
    supers = links.groupBy("g", "super").agg(F.array_sort(F.collect_list("link")).alias("links"))

    def moved(state: Column, into: Column) -> dict[str, Column]:
        way = F.get(into, state["skip"])
        return {"skip": way["skip"], "before": state["before"] + way["opened"]}

    def trace(rows: Column, start: Column, key: str) -> Column:
        """The state each row of ``rows`` leads to, in an array."""
        fields = "array<struct<key:bigint,skip:int,before:bigint>>"
        begin = _struct(skip=start["skip"], before=start["before"], seen=F.array().cast(fields))
        return F.aggregate(rows, begin, lambda state, row: _struct(**(now := moved(state, row["into"])), seen=F.array_append(
            state["seen"], _struct(key=row[key], **now))))["seen"]

    zero = F.lit(0).cast("long")
    whole = F.array(*[F.aggregate("links", _struct(skip=F.lit(k), before=zero), lambda s, link: _struct(
        **moved(s, link["into"]))) for k in range(max_files)])
    shape = F.transform(whole, lambda w: _struct(skip=w["skip"], opened=w["before"]))
    # A row per superblock, of some hundred thousand files each.
    chain = supers.groupBy("g").agg(F.array_sort(F.collect_list(F.struct(
        F.col("super"), shape.alias("into")))).alias("chain"))
    after = chain.select(F.col("g").alias("a_group"), F.inline(
        trace(F.col("chain"), _struct(skip=F.lit(0), before=zero), "super")))
    at_start = after.select("a_group", (F.col("key") + 1).alias("a_super"), "skip", "before")
    started = supers.join(at_start, F.col("g").eqNullSafe(F.col("a_group")) & (F.col("super") == F.col("a_super")), "left")
    start = _struct(skip=F.coalesce("skip", F.lit(0)), before=F.coalesce("before", zero))
    return started.select(F.col("g").alias("entry_group"), F.inline(trace(F.col("links"), start, "part"))).withColumnRenamed(
        "key", "entry_part")


def review_batches(files: DataFrame, group: str, block: str, order: str,
                   max_files: int = BATCH_FILES, max_tokens: int = BATCH_TOKENS) -> DataFrame:
    """Files with the ``batch`` (from 1) that a walk over their group in ``order`` gives them.

    ``block`` numbers ranges of ``order`` of at most MOST_IN_BLOCK files, which is checked;
    ``tokens`` is the estimate of each file. A file over the limit is alone in its batch.
    """
    if max_files > BLOCK_FILES:
        raise ValueError(f"batches of more than {BLOCK_FILES} files")
    parts = _numbered(files, group, block, order).groupBy(group, "part").agg(
        F.array_sort(F.collect_list(F.struct(order, "tokens", block))).alias("files"))
    ends = F.array(*[_fold(F.col("files"), s, max_files, max_tokens) for s in range(max_files)])
    heads = F.transform(F.slice("files", 1, max_files), lambda f: f["tokens"].cast("long"))
    shapes = parts.select(group, "part", ends.alias("ends"), heads.alias("heads"))
    entries = _entry_rows(shapes, group, max_files, max_tokens)
    none = F.lit(0).cast("long")
    start = _struct(number=F.col("before"), files=none, tokens=none,
                    numbers=F.array().cast("array<bigint>"))

    def step(state: Column, file: Column) -> Column:
        joined = _joined(state, file, max_files, max_tokens)
        return _struct(**joined, numbers=F.array_append(state["numbers"], joined["number"]))

    skip = F.least("skip", F.size("files"))
    carried = F.array_repeat(F.col("before"), skip)
    own = F.aggregate(F.slice("files", skip + 1, F.greatest(F.size("files") - skip, F.lit(0))),
                      start, step)["numbers"]
    same = F.col(group).eqNullSafe(F.col("entry_group")) & (F.col("part") == F.col("entry_part"))
    placed = parts.join(entries, same).select(group, F.inline(F.arrays_zip(
        F.col("files").alias("file"), F.concat(carried, own).alias("batch"))))
    return placed.select(group, f"file.{block}", f"file.{order}", "file.tokens", "batch")


def batch_prompts(batched: DataFrame, group: str, order: str) -> DataFrame:
    """One prompt per batch: head, its files in order, tail. A batch holds a few files."""
    numbered = F.array_sort(F.collect_list(F.struct(order, "file_path", "language", "content")))
    parts = F.transform(numbered, lambda f, i: _filled(
        BATCH_FILE, number=(i + 1).cast("string"), file_path=f["file_path"],
        language=f["language"], content=f["content"]))
    return batched.groupBy(group, "batch").agg(
        F.count(F.lit(1)).alias("files"),
        F.concat(F.lit(BATCH_HEAD), F.array_join(parts, ""), F.lit(BATCH_TAIL)).alias("prompt"))


# --- answers ------------------------------------------------------------------------

def _issue_list(text: Column) -> Column:
    """Objects of a JSON list; other elements are left out. Null if the text is no list."""
    strict = {"allowSingleQuotes": "false"}
    elements = F.from_json(F.when(F.startswith(F.trim(text), F.lit("[")), text), "array<string>", strict)
    objects = F.filter(elements, lambda e: F.startswith(e, F.lit("{")))

    def issue(element: Column) -> Column:
        # Lines are read as text: services also send "10" and 10.0.
        found = F.from_json(element, ANSWER_ISSUE.replace(" int", " string"), strict)
        number = lambda name: found[name].try_cast("double").cast("int").alias(name)
        return F.struct(*[number(f) if f.startswith("line_") else found[f].alias(f) for f in ANSWER_FIELDS])

    return F.transform(objects, issue)


def _no_issues() -> Column:
    return F.array().cast(f"array<{ANSWER_ISSUE}>")


def parse_answer(response: Column) -> Column:
    """Issues of an answer about one file: an object with ``issues``, else the text from the
    first ``[`` to the last ``]``, else the whole text; empty if none of them is a list."""
    wrapped = _issue_list(F.get_json_object(response, "$.issues"))
    found = F.regexp_extract(response, r"(?s)\[.*\]", 0)
    listed = _issue_list(F.when(found == "", response).otherwise(found))
    return F.coalesce(wrapped, listed, _no_issues())


def parse_batch_answer(response: Column) -> Column:
    """Map path -> issues from the first ``{`` to the last ``}``; null if that is no object."""
    found = F.regexp_extract(response, r"(?s)\{.*\}", 0)
    by_path = F.from_json(found, "map<string, string>", {"allowSingleQuotes": "false"})
    return F.transform_values(by_path, lambda _, text: F.coalesce(_issue_list(text), _no_issues()))


def batch_answer_issues(batched: DataFrame, answers: DataFrame, group: str) -> DataFrame:
    """Every file of a batch with its issues; a path the answer leaves out has none."""
    parsed = answers.select(group, "batch", parse_batch_answer(F.col("response")).alias("by_path"))
    return batched.join(parsed, [group, "batch"], "left").withColumn(
        "issues", F.coalesce(F.try_element_at("by_path", F.col("file_path")), _no_issues())).drop("by_path")


def _known(value: Column, domain: tuple[str, ...], default: str) -> Column:
    lowered = F.lower(value)
    return F.when(lowered.isin(*domain), lowered).otherwise(default)


def normalise(issues: DataFrame) -> DataFrame:
    """Foreign issues in our terms: known names in lower case, defaults for the rest."""
    return issues.withColumns({
        "category": _known(F.col("category"), CATEGORIES, "maintainability"),
        "severity": _known(F.col("severity"), SEVERITIES, "info"),
        "line_start": F.coalesce("line_start", F.lit(1)),
        "line_end": F.coalesce("line_end", F.lit(1)),
        "description": F.coalesce("description", F.lit("Issue detected by LLM")),
        "recommendation": F.coalesce("recommendation", F.lit("")),
    })
