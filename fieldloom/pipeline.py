"""The whole flow: discover a schema, extract records, choose fields, normalize them."""

from __future__ import annotations

import copy
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.errors import BudgetExceededError, SchemaError
from fieldloom.functions import jsonschema
from fieldloom.operators import usage
from fieldloom.operators.canonical import LLMCanonicalization
from fieldloom.operators.checkpoint import Checkpoint, cut, unprocessed
from fieldloom.operators.discovery import LLMFieldSelector, SinglePassDiscovery
from fieldloom.operators.extraction import LLMDirectExtraction, errors_of, records_of
from fieldloom.operators.mapping import CompositeNormalization, apply_mapping, values_of
from fieldloom.providers import LLMClient, Meter
from fieldloom.schemas import Schema
from fieldloom.sources import documents as sources
from fieldloom.sources import sinks


#: May put another schema in the place of the one that was found.
Hook = Callable[[Schema], Schema | None]


@dataclass
class PipelineResult:
    """Lazily evaluated tables of a run."""

    schema: Schema
    extraction: DataFrame
    normalizations: dict[str, DataFrame]
    usage: DataFrame
    stopped: BudgetExceededError | None = None

    @property
    def records(self) -> DataFrame:
        return records_of(self.extraction)

    @property
    def errors(self) -> DataFrame:
        return errors_of(self.extraction)

    @property
    def provenance(self) -> DataFrame:
        return self.extraction.where("error IS NULL").select("doc_id", "chunk_id", "record_ord", "provenance.*")

    def normalized_records(self) -> DataFrame:
        out = self.records
        for f, mapping in self.normalizations.items():
            out = apply_mapping(out, mapping, f)
        return out

    def report(self) -> DataFrame:
        return usage.usage_report(self.usage)

    def to_dataframe(self) -> DataFrame:
        return self.records

    def to_csv(self, path: str) -> None:
        sinks.to_csv(self.records, path)

    def to_parquet(self, path: str) -> None:
        sinks.to_parquet(self.records, path)

    def to_json(self, path: str) -> None:
        sinks.to_json(self.records, path)


@dataclass
class Pipeline:
    """Strategies of each stage; ``normalization`` may be a strategy, or one for each field.

    ``normalize_fields``: names, ``"all"`` string fields, or None to ask the selector. The calls of
    every stage are metered. With ``max_cost_usd`` extraction goes in ``batches``; once all stages
    together have passed the limit no further batch, selection or field starts, and the result
    holds what was done and why it stopped. ``progress`` is told the stage, and how many of its
    steps are done and planned; ``verbose`` prints the same.
    """

    discovery: object | None = None
    extraction: LLMDirectExtraction | None = None
    normalization: object | None = None
    selector: object | None = None
    max_cost_usd: float | None = None
    batches: int = 8
    checkpoint_path: str | None = None
    pricing: Mapping[str, tuple[float, float]] = field(default_factory=dict)
    progress: Callable[[str, int, int], None] | None = None
    verbose: bool = False

    def _tell(self, stage: str, done: int, planned: int) -> None:
        if self.progress is not None:
            self.progress(stage, done, planned)
        if self.verbose:
            print(f"{stage}: {done} of {planned}", flush=True)

    def _over(self, meter: Meter) -> BudgetExceededError | None:
        """Why to stop, if the calls so far cost more than the limit."""
        prices = {**usage.PRICES, **self.pricing}
        spent = sum((i * prices.get(m, (0, 0))[0] + o * prices.get(m, (0, 0))[1]) / 1e6 for _, _, m, _, i, o, _ in meter.rows())
        return BudgetExceededError(spent, self.max_cost_usd) if self.max_cost_usd is not None and spent > self.max_cost_usd else None

    @classmethod
    def quick(cls, client: LLMClient, **options) -> Pipeline:
        return cls(SinglePassDiscovery(client), LLMDirectExtraction(client), LLMCanonicalization(client), LLMFieldSelector(client), **options)

    @staticmethod
    def _given(schema: dict | Schema) -> Schema:
        found = schema if isinstance(schema, Schema) else Schema(schema, {}, ["user-provided"])
        try:
            jsonschema.to_struct(found.json_schema)
        except SchemaError:
            raise
        except Exception as e:
            raise SchemaError(str(e)) from e
        return found

    def run(
        self, spark: SparkSession, documents: DataFrame | list[str], *, schema: dict | Schema | None = None, normalize_fields: Sequence[str] | str | None = None,
        domain_hint: str = "", on_schema_ready: Hook | None = None,
    ) -> PipelineResult:
        docs, meter = sources.resolve(spark, documents), Meter(spark)
        saved = Checkpoint(spark, self.checkpoint_path) if self.checkpoint_path else None
        found = (saved.load_schema() if saved else None) or (self._given(schema) if schema is not None else None)
        if found is None:
            if self.discovery is None:
                raise SchemaError("a schema or a discovery strategy is needed")
            found = metered(self.discovery, meter, "discovery").discover(docs, domain_hint)
            self._tell("discovery", 1, 1)
        if on_schema_ready is not None:
            found = on_schema_ready(found) or found
        if saved:
            saved.save_schema(found)
        if self.extraction is None:
            raise SchemaError("an extraction strategy is needed")

        todo = unprocessed(docs, saved.processed()) if saved else docs
        stopped = self._over(meter)
        extraction = metered(self.extraction, meter, "extraction")
        parts: list[DataFrame] = []
        n = self.batches if self.max_cost_usd is not None else 1
        for k in range(n):
            if stopped is not None:
                break
            mine = todo.where(F.pmod(F.xxhash64("doc_id", "doc_ord"), F.lit(n)) == k) if n > 1 else todo
            got = cut(extraction.extract(mine, found.json_schema))  # every call is made once
            parts.append(got)
            if saved:
                saved.append(got)
            self._tell("extraction", k + 1, n)
            stopped = self._over(meter)
        result = saved.load_records() if saved else None
        if result is None:
            result = _union(parts) if parts else extraction.extract(todo.where("false"), found.json_schema)

        records = records_of(result)
        strings = [f for f in jsonschema.string_fields(found.json_schema) if f in records.columns]
        if normalize_fields == "all":
            fields = strings
        elif normalize_fields is not None:
            fields = [f for f in normalize_fields if f in records.columns]
        elif self.selector is not None and stopped is None:
            fields = metered(self.selector, meter, "selection").select(records, found.json_schema)
            self._tell("selection", 1, 1)
            stopped = self._over(meter)
        else:
            fields = []
        strategy = CompositeNormalization(self.normalization) if isinstance(self.normalization, Mapping) else self.normalization
        normalized: dict[str, DataFrame] = {}
        strategy = metered(strategy, meter, "normalization")
        for k, f in enumerate(fields if strategy is not None else []):
            if stopped is not None:
                break
            values = values_of(records, f).drop("field")
            if not values.isEmpty():
                if hasattr(strategy, "field_metadata"):
                    strategy.field_metadata = found.field_metadata.get(f)
                normalized[f] = cut(strategy.normalize(values, f))
            self._tell("normalization", k + 1, len(fields))
            stopped = self._over(meter)
        return PipelineResult(found, result, normalized, usage.with_cost(meter.table(), self.pricing), stopped)

    def estimate_cost(self, docs: DataFrame) -> DataFrame:
        return usage.estimate_pipeline_cost(docs)


def metered(strategy: object | None, meter: Meter, stage: str) -> object | None:
    """A copy of a strategy, and of those within it, whose models are metered."""
    if strategy is None or isinstance(strategy, type):
        return strategy
    out = copy.copy(strategy)
    for name in ("client", "llm"):
        if getattr(out, name, None) is not None:
            setattr(out, name, meter.client(getattr(out, name), stage))
    if getattr(out, "embeddings", None) is not None:
        out.embeddings = meter.embeddings(out.embeddings, stage)
    if isinstance(getattr(out, "field_strategies", None), Mapping):
        out.field_strategies = {k: metered(v, meter, stage) for k, v in out.field_strategies.items()}
        out.default = metered(out.default, meter, stage)
    if isinstance(getattr(out, "steps", None), (list, tuple)):
        out.steps = [metered(s, meter, stage) for s in out.steps]
    return out


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
