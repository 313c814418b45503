"""Tables of prompts and of model answers: one row per prompt out, one row per verdict in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import EDGE, G


def edge_prompts(edges: DataFrame, summary: str | Column, context: str | Column = "") -> DataFrame:
    """(graph_id, src, dst, prompt): one validation question per edge with data statistics and domain knowledge."""
    s = F.lit(summary) if isinstance(summary, str) else summary
    c = F.lit(context) if isinstance(context, str) else context
    head = F.format_string("Does %s directly cause %s?", F.col("src"), F.col("dst"))
    ask = F.lit(
        "Weigh mechanism, time order, the statistics, common causes and the opposite direction. Answer in four lines:\n"
        "Valid: Yes or No\nConfidence: 1 to 10\nReverse direction suggested: Yes or No\nReasoning: your steps"
    )
    return edges.select(*EDGE, F.concat_ws("\n\n", head, s, F.when(c != "", c), ask).alias("prompt"))


def _first_line(text: Column, label: str) -> Column:
    """Text after the colon of the first line that starts with the label."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda s: s.startswith(f"{label}:"))
    return F.trim(F.get(F.split(F.get(lines, F.lit(0)), ":"), F.lit(1)))


def parse_edge_verdicts(answers: DataFrame, column: str = "answer") -> DataFrame:
    """Adds is_valid, confidence (of 10, default 0.5), reverse_suggested and reasoning."""
    text = F.coalesce(F.col(column), F.lit(""))
    yes = lambda label: F.coalesce(F.lower(_first_line(text, label)).contains("yes"), F.lit(False))
    at = F.locate("Reasoning:", text)
    return answers.withColumns({
        "is_valid": yes("Valid"),
        "confidence": F.coalesce(_first_line(text, "Confidence").try_cast("double") / 10.0, F.lit(0.5)),
        "reverse_suggested": yes("Reverse direction suggested"),
        "reasoning": F.when(at > 0, F.regexp_replace(F.expr(f"substring({column}, locate('Reasoning:', {column}) + 10)"), r"^\s+|\s+$", "")).otherwise(""),
    })


def apply_verdicts(edges: DataFrame, verdicts: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(graph_id, src, dst, confidence, reversed): valid edges at or above the threshold; invalid ones turn round where the
    answer suggests it (unless that edge is there already); edges without an answer stay at 0.5."""
    v = verdicts.select(*EDGE, "is_valid", F.col("confidence").alias("_c"), "reverse_suggested")
    j = edges.select(*EDGE).distinct().join(v, EDGE, "left")
    kept = j.where(F.col("is_valid").isNull() | (F.col("is_valid") & (F.col("_c") >= threshold)))
    kept = kept.select(*EDGE, F.coalesce("_c", F.lit(0.5)).alias("confidence"), F.lit(False).alias("reversed"))
    turned = j.where(~F.col("is_valid") & F.col("reverse_suggested")).select(
        G, F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("_c").alias("confidence"), F.lit(True).alias("reversed")
    )
    return kept.unionByName(turned.join(kept.select(*EDGE), EDGE, "left_anti"))


def strip_fence(text: Column) -> Column:
    """Inside of the first ```json or ``` block, or the whole text."""
    tagged, plain = F.split(text, "```json"), F.split(text, "```")
    inner = F.when(text.contains("```json"), F.get(F.split(F.get(tagged, F.lit(1)), "```"), F.lit(0))).when(text.contains("```"), F.get(plain, F.lit(1)))
    return F.trim(F.regexp_replace(F.coalesce(inner, text), r"^\s+|\s+$", ""))


def apply_directions(undirected: DataFrame, answers: DataFrame, column: str = "answer") -> DataFrame:
    """(graph_id, src, dst, bidirected): oriented edges from one JSON answer per graph.

    Keys are edge1… (edges in (src, dst) order), a--b or b--a; values forward, backward, bidirected. When no key matches and
    the counts agree, values are taken in order. Edges without a direction are left out.
    """
    w = Window.partitionBy(G).orderBy("src", "dst")  # the edges of one graph
    e = undirected.select(*EDGE).distinct().withColumn("_no", F.row_number().over(w)).withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy(G)))
    parsed = answers.select(G, F.from_json(strip_fence(F.col(column)), "map<string,string>").alias("m"))
    said = parsed.select(G, F.size("m").alias("_answers"), F.posexplode("m").alias("_at", "key", "direction"))
    keys = F.array(F.concat(F.lit("edge"), F.col("_no")), F.concat("src", F.lit("--"), "dst"), F.concat("dst", F.lit("--"), "src"))
    named = e.select("*", F.explode(keys).alias("key")).join(said.select(G, "key", "direction", "_at"), [G, "key"])
    named = named.groupBy(*EDGE).agg(F.max_by("direction", "_at").alias("direction"))
    silent = e.join(named.select(G).distinct(), G, "left_anti")
    by_place = silent.join(said, G).where((F.col("_answers") == F.col("_size")) & (F.col("_at") + 1 == F.col("_no"))).select(*EDGE, "direction")
    found = named.unionByName(by_place)
    fwd, bwd = F.struct(F.col("src").alias("s"), F.col("dst").alias("d")), F.struct(F.col("dst").alias("s"), F.col("src").alias("d"))
    ways = F.when(F.col("direction") == "forward", F.array(fwd)).when(F.col("direction") == "backward", F.array(bwd)).when(F.col("direction") == "bidirected", F.array(fwd, bwd))
    out = found.select(G, F.explode(ways).alias("w"), (F.col("direction") == "bidirected").alias("bidirected"))
    return out.select(G, F.col("w.s").alias("src"), F.col("w.d").alias("dst"), "bidirected")


def parse_hidden_variables(answers: DataFrame, key: list[str], column: str = "answer") -> DataFrame:
    """(key…, number, name, description, children, confidence): blocks that start with "Hidden Variable" and have a name and children."""
    blocks = F.split(F.coalesce(F.col(column), F.lit("")), "Hidden Variable")
    rows = answers.select(*key, F.posexplode(blocks).alias("number", "block")).where("number > 0")

    def last(label: str) -> Column:
        lines = F.filter(F.split(_trimmed(F.col("block")), "\n"), lambda s: s.startswith(f"{label}:"))
        return F.trim(F.substring(F.try_element_at(lines, F.lit(-1)), len(label) + 2, 1_000_000_000))

    kids = F.transform(F.split(last("Affects"), ","), lambda x: F.trim(x))
    out = rows.select(
        *key, "number", F.coalesce(last("Name"), F.lit("")).alias("name"), F.coalesce(last("Description"), F.lit("")).alias("description"),
        F.coalesce(kids, F.array().cast("array<string>")).alias("children"), F.coalesce(last("Confidence").try_cast("double") / 10.0, F.lit(0.5)).alias("confidence"),
    )
    return out.where((F.col("name") != "") & (F.size("children") > 0))


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


# fixed values: the lists of a recommendation answer and their headings in free text
LISTS = {"primary": "primary", "secondary": "secondary", "not_recommended": "not recommended"}


def parse_json_answers(answers: DataFrame, key: list[str], column: str = "answer") -> DataFrame:
    """(key…, list, position, item): entries of the primary, secondary and not_recommended arrays.

    Answers that are not JSON are read by their headings: bulleted or numbered lines after each one.
    """
    text = F.coalesce(F.col(column), F.lit(""))
    doc = F.from_json(strip_fence(text), ", ".join(f"{k} array<string>" for k in LISTS))
    is_json = F.from_json(strip_fence(text), "map<string,string>").isNotNull() & F.get_json_object(strip_fence(text), "$").isNotNull()
    rows = answers.select(*key, doc.alias("d"), is_json.alias("ok"), text.alias("t"))

    def section(heading: str) -> Column:
        stop = "|".join(h for h in LISTS.values() if h != heading)
        part = F.regexp_extract("t", rf"(?is)(?:^|\n)[ #*]*{heading}\b(.*?)(?=\n[ #*]*(?:{stop})\b|$)", 1)
        lines = F.filter(F.split(part, "\n"), lambda s: s.rlike(r"^\s*(?:[-*•]|\d+[.)])\s+\S"))
        return F.transform(lines, lambda s: F.trim(F.regexp_replace(s, r"^\s*(?:[-*•]|\d+[.)])\s+", "")))

    entries = F.array(*[
        F.struct(F.lit(k).alias("list"), F.when(F.col("ok"), F.coalesce(F.col(f"d.{k}"), F.array().cast("array<string>"))).otherwise(section(h)).alias("items"))
        for k, h in LISTS.items()
    ])
    flat = rows.select(*key, F.inline(entries))
    return flat.select(*key, "list", F.posexplode("items").alias("position", "item"))


#: Parts of a knowledge answer with the fields that their entries may have.
KNOWLEDGE = {
    "relationships": ("source", "target", "type", "description", "confidence"),
    "constraints": ("source", "target", "type", "description"),
}


def parse_knowledge_answers(answers: DataFrame, key: list[str], column: str = "answer") -> DataFrame:
    """(key…, part, position, name, source, target, type, description, confidence, possible_values): what a JSON answer says about a domain.

    Parts are ``variables`` (an object by name), ``relationships`` and ``constraints`` (arrays) and ``background`` (a text, as description). The answer is parsed
    once, to a Variant; a fence around it is taken off. Entries of other shapes and answers that are no JSON give no rows; fields that an entry lacks, or that do not
    parse, are null. Variables come in the order of their names.
    """
    doc = answers.select(*key, F.try_parse_json(strip_fence(F.coalesce(F.col(column), F.lit("")))).alias("_v"))
    names = ("name", "source", "target", "type", "description")

    def entry(v: Column, fields, name: Column | None = None) -> Column:
        given = {f: F.try_variant_get(v, f"$.{f}", "string") for f in fields}
        given["name"] = name
        values = F.try_variant_get(v, "$.possible_values", "array<string>")
        text = [(F.lit(None).cast("string") if given.get(f) is None else given[f]).alias(f) for f in names]
        confidence = F.try_variant_get(v, "$.confidence", "double") if "confidence" in fields else F.lit(None).cast("double")
        return F.struct(*text, confidence.alias("confidence"), values.alias("possible_values"))

    def objects(path: str) -> Column:
        return F.filter(F.try_variant_get("_v", path, "array<variant>"), lambda v: F.try_variant_get(v, "$", "map<string,variant>").isNotNull())

    by_name = F.array_sort(F.map_keys(F.try_variant_get("_v", "$.variables", "map<string,variant>")))
    variables = F.map_entries(F.try_variant_get("_v", "$.variables", "map<string,variant>"))
    ordered = F.flatten(F.transform(by_name, lambda n: F.filter(variables, lambda e: e["key"] == n)))
    parts = {"variables": F.transform(ordered, lambda e: entry(e["value"], ("type", "description"), e["key"]))}
    for part, fields in KNOWLEDGE.items():
        parts[part] = F.transform(objects(f"$.{part}"), lambda v: entry(v, fields))
    background = F.try_variant_get("_v", "$.background", "string")
    kind = "struct<name:string,source:string,target:string,type:string,description:string,confidence:double,possible_values:array<string>>"
    alone = F.struct(*[(background if f == "description" else F.lit(None).cast("string")).alias(f) for f in names], F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("array<string>").alias("possible_values"))
    none = F.array().cast(f"array<{kind}>")
    parts["background"] = F.when(F.length(background) > 0, F.array(alone)).otherwise(none)
    rows = doc.select(*key, F.inline(F.array(*[F.struct(F.lit(p).alias("part"), F.coalesce(v, none).alias("entries")) for p, v in parts.items()])))
    return rows.select(*key, "part", F.posexplode("entries").alias("position", "e")).select(*key, "part", "position", "e.*")


#: What the numbers of a direction answer stand for.
DIRECTIONS = {"1": "forward", "2": "backward", "3": "bidirected"}


def parse_conflict_answers(answers: DataFrame, key: list[str], column: str = "answer") -> DataFrame:
    """(key…, direction, confidence): the first ``Direction: 1/2/3`` and ``Confidence: n`` lines; answers without both, or with other values, give no row."""
    lines = F.split(F.coalesce(F.col(column), F.lit("")), "\n")

    def first(label: str) -> Column:
        return F.trim(F.get(F.split(F.get(F.filter(lines, lambda s: F.ltrim(s).startswith(f"{label}:")), 0), ":"), 1))

    names = F.create_map(*[F.lit(x) for kv in DIRECTIONS.items() for x in kv])
    out = answers.select(*key, F.try_element_at(names, first("Direction")).alias("direction"), first("Confidence").try_cast("int").alias("confidence"))
    return out.where("direction is not null and confidence is not null")
