"""Groups of spellings: from model replies to a mapping, merged by name and then by meaning."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.plain import strip_fences
from fieldloom.functions.text import sanitize, strip_blank
from fieldloom.operators.checkpoint import cut
from fieldloom.operators.mapping import frequencies
from fieldloom.operators.numbering import numbered
from fieldloom.providers import LLMClient, in_flight

#: Groups are ``(ord, canonical, members, rationale)``; ``members`` in order.
GROUPS = "ord bigint, canonical string, members array<string>, rationale string"


def parse_groups(reply: str, expected: list[str]) -> list[tuple[str, list[str], str]]:
    """Groups of a reply, as text; groups without a name or members are dropped, values in no group become their own."""
    got = json.loads(strip_fences(reply))
    items = got.get("groups", []) if isinstance(got, dict) else got
    out, seen = [], set()
    for g in items if isinstance(items, list) else []:
        if isinstance(g, dict) and g.get("canonical") and isinstance(g.get("members"), list) and g["members"]:
            members = [str(m) for m in g["members"]]
            out.append((str(g["canonical"]), members, str(g.get("rationale") or "")))
            seen.update(members)
    return out + [(v, [v], "ungrouped") for v in expected if v not in seen]


def group_key(c: Column) -> Column:
    return F.lower(strip_blank(c))


def merge_groups(groups: DataFrame) -> DataFrame:
    """Groups of the same name (case and outer blanks don't count) as one.

    The first spelling stays. The first group's members stay as they are, those of the later
    ones are added in order unless they are there; reasons are joined by ``; ``.
    """
    lists = groups.groupBy(group_key(F.col("canonical")).alias("__key")).agg(
        F.min("ord").alias("ord"), F.min_by("canonical", "ord").alias("canonical"),
        F.array_sort(F.collect_list(F.struct("ord", "members", F.coalesce("rationale", F.lit("")).alias("rationale")))).alias("g"),
    )
    first = F.element_at(F.col("g.members"), 1)
    later = F.array_distinct(F.flatten(F.slice(F.col("g.members"), 2, F.greatest(F.size("g") - 1, F.lit(0)))))
    reasons = F.array_join(F.filter(F.col("g.rationale"), lambda r: r != ""), "; ")
    return lists.select("ord", "canonical", F.concat(first, F.array_except(later, first)).alias("members"), reasons.alias("rationale"))


def merge_by_instructions(groups: DataFrame, instructions: DataFrame) -> DataFrame:
    """Groups put together as ``instructions(ord, canonical, merge)`` say, ``merge`` being names of groups.

    A group goes to the first instruction that names it; names that don't exist are ignored,
    groups that none names stay.
    """
    named = instructions.select(F.col("ord").alias("i_ord"), F.col("canonical").alias("to"), F.posexplode("merge").alias("pos", "name"))
    first = Window.partitionBy("name").orderBy("i_ord", "pos")
    once = named.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    hit = once.join(groups, F.col("name") == F.col("canonical")).select("i_ord", "to", "pos", "name", "ord", "members", "rationale")
    merged = hit.groupBy("i_ord", "to").agg(F.array_sort(F.collect_list(F.struct("pos", "members", F.coalesce("rationale", F.lit("")).alias("r")))).alias("g"), F.min("ord").alias("ord"))
    new = merged.select("ord", F.col("to").alias("canonical"), F.array_distinct(F.flatten(F.col("g.members"))).alias("members"), F.array_join(F.filter(F.col("g.r"), lambda r: r != ""), "; ").alias("rationale"))
    rest = groups.join(hit.select(F.col("name").alias("canonical")), "canonical", "left_anti").select("ord", "canonical", "members", "rationale")
    return new.unionByName(rest)


def to_mapping(groups: DataFrame, values: DataFrame, context_field: str = "", strategy: str = "model") -> DataFrame:
    """``groups`` over sanitized values, as a mapping of the ``values(value)`` they come from.

    A value in several groups takes the last; what is in none stays as it is. Confidence is
    0.85, or 1.0 for the name of a group itself.
    """
    members = groups.select("ord", "canonical", "rationale", F.explode("members").alias("__m"))
    last = members.groupBy("__m").agg(F.max_by(F.struct("canonical", "rationale"), "ord").alias("g"))
    distinct = values.where("value IS NOT NULL").select("value").distinct().withColumn("__s", sanitize(F.col("value")))
    joined = distinct.join(last, F.col("__s") == F.col("__m"), "left")
    to = F.coalesce(F.col("g.canonical"), F.col("value"))
    return joined.select(
        F.lit(context_field).alias("field"), F.col("value").alias("raw"), to.alias("canonical"), F.when(to == F.col("value"), 1.0).otherwise(0.85).alias("confidence"),
        F.lit(None).cast("string").alias("ontology_id"), F.nullif(F.col("g.rationale"), F.lit("")).alias("explanation"), F.lit(strategy).alias("strategy"),
    )


def schema_context(metadata: dict | None) -> str:
    """What a prompt says about a field: description, up to ten examples and synonyms, constraints."""
    m = metadata or {}
    lines = [f"Description: {m['description']}"] if m.get("description") else []
    lines += [f"{k.capitalize()}: {', '.join(map(str, m[k][:10]))}" for k in ("examples", "synonyms") if m.get(k)]
    return "\n".join(lines + ([f"Constraints: {m['constraints']}"] if m.get("constraints") else []))


def group_prompt(values: list[str], field: str = "", metadata: dict | None = None) -> str:
    return "\n".join(
        [f"Group the spellings of the same thing{f' in {field!r}' if field else ''}; reply with groups of canonical, members, rationale as JSON.", schema_context(metadata), *[f"- {v}" for v in values]]
    )


@dataclass
class LLMCanonicalization:
    """Groups by a model: in one call for few values, in batches by order and merged for many.

    A batch whose call fails leaves its values as they are. With ``hierarchical_merge`` the
    names of the groups are grouped again, up to ``rounds`` times or until nothing merges.
    """

    client: LLMClient
    batch_size: int = 50
    max_values_per_prompt: int = 200
    hierarchical_merge: bool = True
    rounds: int = 1
    field_metadata: dict | None = None
    concurrency: int = 8

    def _call(self, batches: DataFrame, field: str) -> DataFrame:
        """Groups for each row of ``(batch, values)``."""
        client, metadata, at_once = self.client, self.field_metadata, self.concurrency

        def ask(item: tuple) -> list[tuple]:
            b, values = int(item[0]), list(item[1])
            try:
                groups = parse_groups(client.complete([{"role": "user", "content": group_prompt(values, field, metadata)}]).content, values)
            except Exception:  # noqa: BLE001 - the values of a batch whose call fails stay as they are
                groups = [(v, [v], "") for v in values]
            return [(b * 100_000 + k, *g) for k, g in enumerate(groups)]

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                made = in_flight(ask, list(zip(pdf.batch, pdf["values"])), at_once)
                yield pd.DataFrame([r for rows in made for r in rows], columns=["ord", "canonical", "members", "rationale"])

        return batches.mapInPandas(run, GROUPS)

    @staticmethod
    def _batches(rows: DataFrame, size: int, n: int, first: str, name: str) -> DataFrame:
        """``(batch, values)``: runs of ``size`` of ``n`` names in their order."""
        placed = rows.withColumn("r", F.col(first)).withColumn("batch", F.lit(0).cast("bigint")) if n <= size else numbered(rows, first, name).withColumn("batch", F.floor(F.col("r") / size))
        lists = placed.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("r", F.col(name).alias("v")))).alias("v"))
        return lists.select("batch", F.col("v.v").alias("values"))

    def normalize(self, values: DataFrame, context_field: str = "") -> DataFrame:
        freq = frequencies(values.withColumn("value", F.col("value")))
        clean = freq.select(sanitize(F.col("value")).alias("value"), "first_ord", "freq").groupBy("value").agg(F.min("first_ord").alias("first_ord"))
        n = clean.count()
        if n <= 1:
            none = values.sparkSession.createDataFrame([], GROUPS)
            return to_mapping(none, values, context_field)
        size = n if n <= self.max_values_per_prompt else self.batch_size
        clean = clean.select("value", F.coalesce("first_ord", F.lit(0)).alias("first_ord"))
        batches = self._batches(clean, size, n, "first_ord", "value")
        groups = self._call(batches.repartition("batch"), context_field)
        groups = cut(groups)  # each model call is made once
        if n > self.max_values_per_prompt:
            groups = merge_groups(groups)
            for _ in range(self.rounds if self.hierarchical_merge else 0):
                names = groups.select("ord", "canonical")
                count = names.count()
                if count < 2:
                    break
                again = self._batches(names, self.max_values_per_prompt, count, "ord", "canonical")
                instructions = self._call(again, context_field).where(F.size("members") > 1).select("ord", "canonical", F.col("members").alias("merge"))
                groups = merge_groups(merge_by_instructions(groups, cut(instructions)))
                if groups.count() >= count:
                    break
        return to_mapping(groups, values, context_field)
