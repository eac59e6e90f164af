"""The whole run: candidates, arbitration, substitutes, rebuilt text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesieve.config import Config
from lakesieve.functions.spans import SPANS, crosses, none, rebuild, resolve, split_names
from lakesieve.operators import addresses, evaluate, gazetteer, ner, structured, surrogates, windows
from lakesieve.sources.stage import held


@dataclass
class Result:
    """resolved: records with their spans and the number that hard boundaries kept from being written; detections: a row for each
    span with canonical and replacement; output: records with the new text; gazetteer: the dictionary, if one was built."""

    resolved: DataFrame
    detections: DataFrame
    output: DataFrame
    gazetteer: DataFrame | None


def candidates(records: DataFrame, config: Config = Config()) -> DataFrame:
    """records with the candidates of all detectors that look at one record alone."""
    rows = structured.detect(records, config.types)
    if "POSTAL_ADDRESS" in config.types:
        header = F.col("column_header") if "column_header" in records.columns else None
        rows = rows.withColumn("_found", addresses.found_addresses(F.col("text"), header)).withColumn("candidates", F.concat("candidates", addresses.address_spans(F.col("text"), F.col("_found")))).drop("_found")
    return rows


def arbitrate(rows: DataFrame, config: Config = Config()) -> DataFrame:
    """records with spans and skipped: allowed terms are dropped, names are split at hard boundaries, overlaps are settled, and what
    still crosses a boundary is counted and dropped."""
    wanted = F.filter("candidates", lambda s: s["pii_type"].isin(*sorted(config.types)) & ~(s["pii_type"].isin("PERSON", "COMPANY") & gazetteer.veto_column(s["text"], config.allowlist)))
    out = rows.withColumn("candidates", wanted)
    if "boundaries" not in rows.columns:
        return out.withColumn("spans", resolve(F.col("candidates"))).withColumn("skipped", F.lit(0)).drop("candidates")
    out = out.withColumn("candidates", split_names(F.col("text"), F.col("candidates"), F.coalesce("boundaries", F.array().cast("array<struct<start:int,end:int>>"))))
    out = out.withColumn("_all", resolve(F.col("candidates")))
    out = out.withColumn("spans", F.filter("_all", lambda s: ~crosses(s, F.col("boundaries"))))
    return out.withColumn("skipped", F.size("_all") - F.size("spans")).drop("_all", "candidates")


def spans_of(resolved: DataFrame) -> DataFrame:
    keep = [c for c in ("doc_id", "record_id", "part_name", "ord") if c in resolved.columns]
    return resolved.select(*keep, F.explode("spans").alias("_s")).select(*keep, "_s.*")


def substitute(resolved: DataFrame, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """(detections, output): only records with spans meet the substitutes again; the others pass."""
    found = held(surrogates.assign(held(spans_of(resolved)), config.seed, config.per_document, frozenset(config.types)))
    per_record = found.groupBy("doc_id", "record_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "replacement"))).alias("_r"))
    output = resolved.join(per_record, ["doc_id", "record_id"], "left").withColumn("text", F.when(F.col("_r").isNull(), F.col("text")).otherwise(rebuild(F.col("text"), F.col("_r")))).drop("_r")
    return found, output


def run(records: DataFrame, cells: DataFrame | None = None, config: Config = Config(), model: Callable | None = None) -> Result:
    """records: doc_id, record_id, part_name, ord, text and, where there are, cell_key, table_headers, column_header, boundaries."""
    rows, entries = records, None
    names = bool({"PERSON", "COMPANY"} & set(config.types))
    words = held(gazetteer.vocabulary(records)) if names else None
    seeds = None
    if names and model and config.use_ner:
        first = gazetteer.build(records, cells, words, config.company_scope, config.known_sections)
        stems = first.where("pii_type = 'COMPANY'").select("doc_id", F.lower("canonical").alias("stem"))
        rows = ner.accepted(ner.traces(ner.entities(records, model), words, stems)).drop("entities", "traces")
        if config.company_scope != "all":
            rows = rows.withColumn("ner_spans", F.filter("ner_spans", lambda s: (s["pii_type"] != "COMPANY") | (F.try_element_at(s["metadata"], F.lit("known_party")) == "true")))
        seeds = ner.as_aliases(ner.name_seeds(rows, config.company_scope), first)
        if config.company_scope == "all":
            seeds = seeds.unionByName(ner.brand_seeds(records, first.where("pii_type = 'COMPANY'"), words))
    rows = held(candidates(rows, config))
    if "ner_spans" in rows.columns:
        rows = rows.withColumn("candidates", F.concat("candidates", F.coalesce("ner_spans", none()).cast(SPANS))).drop("ner_spans")
    if names:
        entries = held(gazetteer.build(records, cells, words, config.company_scope, config.known_sections, seeds, camel=model is not None and config.use_ner))
        rows = gazetteer.with_matches(rows, entries)
    if "POSTAL_ADDRESS" in config.types and "cell_key" in records.columns:
        rows = windows.with_block_addresses(rows, config.protected_from)
    if cells is not None:
        terms = gazetteer.glossary(cells).groupBy("doc_id").agg(F.collect_set(gazetteer.normal_term(F.col("term"))).alias("_terms"))
        defined = lambda s: s["pii_type"].isin("PERSON", "COMPANY") & F.array_contains(F.coalesce("_terms", F.array().cast("array<string>")), gazetteer.normal_term(s["text"]))
        rows = rows.join(terms, "doc_id", "left").withColumn("candidates", F.filter("candidates", lambda s: ~defined(s))).drop("_terms")
    resolved = held(arbitrate(rows, config))
    detections, output = substitute(resolved, config)
    return Result(resolved, detections, output, entries)


def counts(detections: DataFrame) -> DataFrame:
    """Detections by type."""
    return detections.groupBy("pii_type").agg(F.count(F.lit(1)).alias("n")).orderBy("pii_type")


def verify(result: Result, vocabulary: DataFrame | None = None) -> None:
    """Raises if two values share a substitute, two sites a host, or, given the documents' common words, if the output still holds
    the surname of a person who was replaced."""
    if bad := surrogates.collisions(result.detections).limit(3).collect():
        raise ValueError(f"substitutes that stand for several values: {', '.join(r['replacement'] for r in bad)}")
    if bad := surrogates.host_collisions(result.detections).limit(3).collect():
        raise ValueError(f"hosts that stand for several sites: {', '.join(r['host'] for r in bad)}")
    if vocabulary is not None and (bad := evaluate.surname_leaks(result.detections, result.output, vocabulary).limit(3).collect()):
        raise ValueError(f"records with surnames of replaced people: {', '.join(r['record_id'] for r in bad)}")
