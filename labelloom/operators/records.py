"""Chat records, prompts, and structured answers read from noisy text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.functions.text import col, folded, stripped, truth

ANSWER = "cell_type string, cell_ontology_id string, parent_cell_type string, supporting_markers string, contradictory_markers string, confidence_label string, confidence_score string, need_manual_review string, decision string, novelty_flag string, evidence_support_level string, rationale string"
# The values of the answer's closed fields.
CONFIDENCE, DECISIONS, EVIDENCE = ("high", "medium", "low"), ("accept", "review", "unresolved", "novel_candidate"), ("strong", "moderate", "weak", "conflicting")


def conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """One row a conversation with messages in order: array of (role, content)."""
    items = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col("role").alias("role"), F.col("text").alias("content"))))
    return turns.groupBy(conv).agg(F.transform(items, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def prompt_part(messages: str | Column) -> Column:
    """Messages without those of the assistant."""
    return F.filter(col(messages), lambda m: m["role"] != "assistant")


def last_answer(messages: str | Column) -> Column:
    """Content of the last message of the assistant; null without one."""
    return F.try_element_at(F.filter(col(messages), lambda m: m["role"] == "assistant"), F.lit(-1))["content"]


def with_suffix(messages: str | Column, role: str, suffix: str | Column) -> Column:
    """messages with suffix on a new line after each one of role."""
    end = F.lit(suffix) if isinstance(suffix, str) else suffix
    return F.transform(col(messages), lambda m: F.struct(m["role"].alias("role"), F.when(m["role"] == role, F.concat_ws("\n", m["content"], end)).otherwise(m["content"]).alias("content")))


def sound_messages(messages: str | Column) -> Column:
    """Whether there are at least two messages, each with role and content."""
    m = col(messages)
    return (F.size(m) >= 2) & ~F.exists(m, lambda x: x["role"].isNull() | x["content"].isNull() | (x["content"] == ""))


def content_text(content: str | Column) -> Column:
    """Content that is text, or the joined texts of a JSON list of typed parts."""
    parts = F.from_json(col(content), "array<struct<type:string,text:string>>")
    return F.when(stripped(content).startswith("["), F.coalesce(F.array_join(F.transform(parts, lambda p: p["text"]), "\n"), col(content))).otherwise(col(content))


def without_thought(text: str | Column) -> Column:
    """Text after the last </think>, and without closed <think> blocks."""
    s = F.regexp_replace(col(text), r"(?s)<think>.*?</think>", "")
    return stripped(F.regexp_replace(s, r"(?s)^.*</think>", ""))


def unfenced(text: str | Column) -> Column:
    """The inside of the first code fence, or the text."""
    inside = F.regexp_extract(col(text), r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.when(inside != "", inside).otherwise(col(text))


def _once(c: Column, f) -> Column:
    """f(c), with c worked out once however often f uses it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def first_object(text: str | Column) -> Column:
    """The first whole {...} of text, braces inside strings aside; null without one.

    The text is cut behind each brace, quote and escape, so the fold that tracks depth and strings has a step for each of
    these, not for each character. A backslash is an escape inside strings only; a piece has one at its last but one place
    at most.
    """
    def found(s: Column) -> Column:
        pieces = F.regexp_extract_all(s, F.lit(r'[^{}"\\]*+(?:\\[\s\S]|["{}]|\\?\z)'), F.lit(0))
        start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("n"), F.lit(False).alias("over"))

        def step(at: Column, piece: Column) -> Column:
            last, plain = F.right(piece, F.lit(1)), ~at["quoted"]
            depth = at["depth"] + F.when(plain & (last == "{"), 1).when(plain & (last == "}"), -1).otherwise(0)
            turns = (last == '"') & (plain | ~piece.contains("\\"))
            moved = F.struct(depth.alias("depth"), (at["quoted"] != turns).alias("quoted"), (at["n"] + F.length(piece)).alias("n"), ((depth == 0) & plain & (last == "}")).alias("over"))
            return F.when(at["over"], at).otherwise(moved)

        return _once(F.aggregate(pieces, start, step), lambda end: F.when(end["over"], F.substring(s, F.lit(1), end["n"])))

    return _once(F.regexp_replace(col(text), r"(?s)^[^{]*", ""), found)


def json_text(text: str | Column) -> Column:
    """JSON of an object in noisy text: the text itself, else its first whole object, else from the first to the last brace."""
    valid = lambda c: _once(c, lambda x: F.when(F.try_parse_json(x).isNotNull() & stripped(x).startswith("{"), x))
    greedy = lambda s: F.nullif(F.regexp_extract(s, r"(?s)\{.*\}", 0), F.lit(""))
    return _once(unfenced(without_thought(text)), lambda s: F.coalesce(valid(s), valid(first_object(s)), valid(greedy(s))))


def _listed(c: Column) -> Column:
    """A JSON list of strings, or a comma-separated string, as an array."""
    return F.coalesce(F.from_json(c, "array<string>"), F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))


def _one_of(c: Column, values: tuple[str, ...], default: str) -> Column:
    """The value that c is, or else holds, in the order given; else default."""
    s, out = folded(c), None
    for v in values:
        out = F.when(s == v, v) if out is None else out.when(s == v, v)
    for v in values:
        out = out.when(s.contains(v), v)
    return out.otherwise(default)


def parsed_answer(text: str | Column) -> Column:
    """The answer in text as a struct, every field filled, repaired and in its type; parse_ok tells whether there was one."""
    return _once(F.from_json(json_text(text), ANSWER), _repaired)


def _repaired(a: Column) -> Column:
    blank = lambda c: F.coalesce(stripped(c), F.lit(""))
    score = F.coalesce(a["confidence_score"].try_cast("double"), F.lit(0.0))
    return F.struct(
        a.isNotNull().alias("parse_ok"), blank(a["cell_type"]).alias("cell_type"), blank(a["cell_ontology_id"]).alias("cell_ontology_id"), blank(a["parent_cell_type"]).alias("parent_cell_type"),
        _listed(a["supporting_markers"]).alias("supporting_markers"), _listed(a["contradictory_markers"]).alias("contradictory_markers"),
        _one_of(a["confidence_label"], CONFIDENCE, "low").alias("confidence_label"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("confidence_score"),
        F.coalesce(truth(a["need_manual_review"]), F.lit(True)).alias("need_manual_review"), _one_of(a["decision"], DECISIONS, "review").alias("decision"),
        F.coalesce(truth(a["novelty_flag"]), F.lit(False)).alias("novelty_flag"), _one_of(a["evidence_support_level"], EVIDENCE, "weak").alias("evidence_support_level"),
        blank(a["rationale"]).alias("rationale"),
    )


def answer_json(**fields: str | Column) -> Column:
    """JSON of an answer, fields in the given order, nulls kept."""
    return F.to_json(F.struct(*(col(c).alias(k) for k, c in fields.items())), {"ignoreNullFields": "false"})


def marker_lines(markers: str | Column) -> Column:
    """Numbered lines of an array of markers (gene, lfc, pct_in, pct_out)."""
    line = lambda m, i: F.format_string("%d. %s (logFC=%.2f, pct_in=%.2f, pct_out=%.2f)", i + 1, m["gene"], m["lfc"].cast("double"), m["pct_in"].cast("double"), m["pct_out"].cast("double"))
    return F.array_join(F.transform(col(markers), line), "\n")


FIELDS = ("Organism", "Tissue", "Disease", "Cluster size")


def prompt(organism: str | Column, tissue: str | Column, disease: str | Column, n_cells: str | Column, genes: str | Column, hint: str | Column | None = None) -> Column:
    """The question about one group: a line for each field, the ranked genes, and a hint if given."""
    known = lambda c: F.coalesce(col(c).cast("string"), F.lit("unknown"))
    lines = [F.concat(F.lit(f"{name}: "), known(c)) for name, c in zip(FIELDS, (organism, tissue, disease, n_cells), strict=True)]
    lines += [F.concat(F.lit("Ranked markers: "), F.array_join(col(genes), ", "))]
    return F.concat_ws("\n", *lines, *([col(hint)] if hint is not None else []))


def prompt_field(text: str | Column, name: str) -> Column:
    """A field of a prompt by its name; null if it isn't there."""
    return F.nullif(F.trim(F.regexp_extract(col(text), rf"(?m)^{name}:[ \t]*(.*)$", 1)), F.lit(""))


def missing_keys(columns: dict[str, Column]) -> Column:
    """Names of the required columns that are null."""
    return F.array_compact(F.array(*(F.when(c.isNull(), F.lit(k)) for k, c in columns.items())))


def chat_record(system: str | Column, question: str | Column, answer: str | Column) -> Column:
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), (F.lit(c) if isinstance(c, str) and " " in c else col(c)).alias("content"))
    return F.array(turn("system", system), turn("user", question), turn("assistant", answer))


def with_turn_numbers(turns: DataFrame, conv: str, order: str) -> DataFrame:
    return turns.withColumn("turn", F.row_number().over(Window.partitionBy(conv).orderBy(order)) - 1)
