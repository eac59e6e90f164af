"""Evaluation: matching of predicted spans with a gold standard, metrics, intervals, token accuracy, and checks of what a run
left behind."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesieve.functions.spans import rebuild
from lakesieve.sources.stage import held


def in_corpus(predictions: DataFrame, corpus: DataFrame) -> DataFrame:
    """Predictions for records of the corpus."""
    return predictions.join(corpus.select("record_id"), "record_id", "left_semi")


def strict_matches(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """record_id, pii_type, start, end, outcome (tp, fp, fn) and stratum: exact type and boundaries, one to one. Of n gold and m
    predicted copies of one span min(n, m) match."""
    keys = ["record_id", "pii_type", "start", "end"]
    g = gold.groupBy(*keys).agg(F.count(F.lit(1)).alias("g"), F.min("stratum").alias("stratum"))
    p = predictions.groupBy(*keys).agg(F.count(F.lit(1)).alias("p"))
    both = g.join(p, keys, "full_outer").fillna(0, ["g", "p"])
    counted = both.select(*keys, "stratum", F.explode(F.array(*(F.struct(F.lit(o).alias("outcome"), n.alias("n")) for o, n in (("tp", F.least("g", "p")), ("fp", F.greatest(F.col("p") - F.col("g"), F.lit(0))), ("fn", F.greatest(F.col("g") - F.col("p"), F.lit(0))))))).alias("x"))
    return counted.where("x.n > 0").select(*keys, "stratum", "x.outcome", "x.n")


def relaxed_matches(gold: DataFrame, predictions: DataFrame, mode: str = "exact_first") -> DataFrame:
    """The same for spans of one type that overlap: greedily in gold order (seq), each with the best unused prediction of its
    record. mode exact_first prefers the exact one, then the largest overlap; mode reference puts any partial overlap first.
    Only spans of one record and type meet."""

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        truth = rows[rows["is_gold"]].sort_values("seq")
        guess = rows[~rows["is_gold"]].sort_values("seq")
        free, out = list(guess.itertuples()), []
        for t in truth.itertuples():
            def cost(p) -> tuple:  # noqa: ANN001
                exact = p.start == t.start and p.end == t.end
                shared = min(p.end, t.end) - max(p.start, t.start)
                return (-10**9 if mode == "exact_first" else 0) if exact else -shared, p.seq
            near = [p for p in free if p.start < t.end and t.start < p.end]
            if near:
                free.remove(min(near, key=cost))
            out.append((t.record_id, t.pii_type, t.start, t.end, t.stratum, "tp" if near else "fn", 1))
        out += [(p.record_id, p.pii_type, p.start, p.end, None, "fp", 1) for p in free]
        return pd.DataFrame(out, columns=["record_id", "pii_type", "start", "end", "stratum", "outcome", "n"])

    cols = ["record_id", "pii_type", "start", "end", "seq"]
    rows = gold.select(*cols, "stratum", F.lit(True).alias("is_gold")).unionByName(predictions.select(*cols, F.lit(None).cast("string").alias("stratum"), F.lit(False).alias("is_gold")))
    return rows.groupBy("record_id", "pii_type").applyInPandas(group, "record_id string, pii_type string, start int, end int, stratum string, outcome string, n long")


def ratio(a: Column, b: Column, empty: float = 1.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty))


def metrics(outcomes: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall, f1, jaccard and over_redaction for each type and, as OVERALL, for all."""
    count = lambda o: F.coalesce(F.sum(F.when(F.col("outcome") == o, F.col("n"))), F.lit(0)).cast("long").alias(o)
    rows = outcomes.rollup("pii_type").agg(count("tp"), count("fp"), count("fn"), F.grouping("pii_type").alias("_all"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    rows = rows.withColumns({"pii_type": F.when(F.col("_all") == 1, "OVERALL").otherwise(F.col("pii_type")), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "jaccard": ratio(tp, tp + fp + fn), "over_redaction": ratio(fp, tp + fp, 0.0)}).drop("_all")
    return rows.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 0.0))


def wilson(successes: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; (1, 1) for no trials."""
    n = F.when(total > 0, total.cast("double"))
    p = successes / n
    middle, spread = p + z * z / (2 * n), z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    return F.coalesce((middle - spread) / (1 + z * z / n), F.lit(1.0)), F.coalesce((middle + spread) / (1 + z * z / n), F.lit(1.0))


def recall_interval(outcomes: DataFrame, stratum: str = "B_prose") -> DataFrame:
    """Recall with its interval over the gold spans of one stratum."""
    rows = outcomes.where(F.col("stratum").contains(stratum)).agg(F.coalesce(F.sum(F.when(F.col("outcome") == "tp", F.col("n"))), F.lit(0)).alias("hits"), F.coalesce(F.sum(F.when(F.col("outcome").isin("tp", "fn"), F.col("n"))), F.lit(0)).alias("total"))
    low, high = wilson(F.col("hits"), F.col("total"))
    return rows.select("hits", "total", ratio(F.col("hits"), F.col("total")).alias("recall"), low.alias("low"), high.alias("high"))


def tokens(corpus: DataFrame, *keys: str) -> DataFrame:
    """keys, start, end: a row for each word between white space. Offsets are running sums over the pieces of a text."""
    pieces = corpus.select(*keys, F.posexplode(F.split("text", r"(?U)(?<=\s)(?=\S)|(?<=\S)(?=\s)")).alias("_n", "_piece"))
    before = F.coalesce(F.sum(F.length("_piece")).over(Window.partitionBy(*keys).orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = pieces.withColumn("start", before.cast("int")).where(F.col("_piece").rlike(r"(?U)^\S"))
    return rows.select(*keys, "start", (F.col("start") + F.length("_piece")).cast("int").alias("end"))


def token_accuracy(corpus: DataFrame, gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """correct, total, accuracy: tokens that gold and prediction both touch, or both do not, whatever the type."""
    def spans(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("record_id").agg(F.collect_list(F.struct("start", "end")).alias(name))

    rows = tokens(corpus, "record_id").join(spans(gold, "g"), "record_id", "left").join(spans(predictions, "p"), "record_id", "left")
    touched = lambda c: F.coalesce(F.exists(c, lambda s: (s["start"] < F.col("end")) & (F.col("start") < s["end"])), F.lit(False))
    sums = rows.agg(F.coalesce(F.sum((touched("g") == touched("p")).cast("long")), F.lit(0)).alias("correct"), F.count(F.lit(1)).alias("total"))
    return sums.select("correct", "total", ratio(F.col("correct"), F.col("total")).alias("accuracy"))


def image_metrics(gold: DataFrame, audit: DataFrame) -> DataFrame:
    """For each category of sensitive pictures how many there are and how many the audit lists, and one row for all."""
    hit = audit.select("media_path", F.lit(1).alias("hit")).distinct()
    rows = gold.where("sensitive").join(hit, "media_path", "left")
    return rows.rollup("category").agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum("hit"), F.lit(0)).cast("long").alias("hits")).fillna("OVERALL", ["category"])


def set_differences(gold: DataFrame, audit: DataFrame) -> DataFrame:
    """media_path and outcome: found (in both), extra (audit alone), missed (gold alone)."""
    g, a = gold.where("sensitive").select("media_path"), audit.select("media_path")
    return g.intersect(a).withColumn("outcome", F.lit("found")).unionByName(a.subtract(g).withColumn("outcome", F.lit("extra"))).unionByName(g.subtract(a).withColumn("outcome", F.lit("missed")))


#: Words, and places in a text by the word there with the first letter of the next; the same of words with a digit.
_WORD, _PLACE = r"(?U)\w+", r"(?U)(?<!\w)(?=(\w+\W+\w))"
_DIGIT_WORD, _DIGIT_PLACE = r"(?U)(?<!\w)\w*\d\w*", r"(?U)(?<!\w)(?=(\w*\d\w*\W+\w))"


def _found(text: Column, word: str, place: str) -> Column:
    words = F.transform(F.regexp_extract_all(text, F.lit(word), F.lit(0)), lambda w: F.concat(F.lit("w"), F.lower(w)))
    return F.array_distinct(F.concat(words, F.transform(F.regexp_extract_all(text, F.lit(place), F.lit(1)), lambda g: F.concat(F.lit("p"), g))))


def _keyed(values: DataFrame) -> DataFrame:
    """pii_type, original, _word (its first word), _key and _rare: every text with the original and its first word has the key. Of an
    original's keys it is the one that fewest originals have. _rare: only texts with an at sign, or keys with a digit, need a look."""
    rows = values.select("pii_type", F.col("text").alias("original"), F.lower(F.regexp_extract("text", _WORD, 0)).alias("_word")).where("_word <> ''")
    inner = F.regexp_extract_all("original", F.lit(_PLACE), F.lit(1))
    keys = F.concat(F.array(F.concat(F.lit("w"), "_word")), F.transform(F.when(F.size(inner) > 1, F.slice(inner, 2, F.greatest(F.size(inner) - 1, F.lit(1)))).otherwise(F.array().cast("array<string>")), lambda g: F.concat(F.lit("p"), g)))
    rows = rows.withColumn("_key", F.explode(F.array_distinct(keys)))
    # Of a place the first word counts: what follows it is cut off.
    rows = rows.withColumn("_rare", F.col("original").contains("@") | F.regexp_extract(F.substring("_key", 2, 2**30), _WORD, 0).rlike(r"(?U)\d"))
    shared = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_many"))
    best = F.min_by(F.struct("_key", "_rare"), F.struct((~F.col("_rare")).alias("a"), F.col("_many").alias("b"), F.col("_key").alias("c")))
    return rows.join(shared, "_key").groupBy("pii_type", "original", "_word").agg(best.alias("_best")).select("pii_type", "original", "_word", "_best.*")


def leaks(mapping: DataFrame, output: DataFrame) -> DataFrame:
    """Originals that the output still holds: values whose first word is in a record are compared with it. Originals that are part of a
    substitute, and people of one name, are left out. Records and values meet by the value's rarest key, so that values which
    begin alike do not all meet all records that hold their first word."""
    keyed = held(_keyed(mapping.where(~((F.col("pii_type") == "PERSON") & ~F.col("text").contains(" "))).select("pii_type", "text").distinct()))
    keys = _found(F.col("text"), _WORD, _PLACE)
    if keyed.where("NOT _rare").isEmpty():
        keys = F.when(F.col("text").contains("@"), keys).when(F.col("text").rlike(r"\p{Nd}"), _found(F.col("text"), _DIGIT_WORD, _DIGIT_PLACE))
    has_word = lambda text: F.array_contains(F.transform(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), F.lower), F.col("_word"))
    # Keys meet alone; only records with a hit bring their text.
    near = held(output.select("record_id", F.explode(keys).alias("_key")).join(keyed, "_key").select("record_id", "pii_type", "original", "_word").distinct())
    hit = near.join(output.select("record_id", "text"), "record_id").where(F.col("text").contains(F.col("original")) & has_word("text"))
    fakes = mapping.select("replacement").distinct().select("replacement", F.explode(_found(F.col("replacement"), _WORD, _PLACE)).alias("_key"))
    own = keyed.join(fakes, "_key").where(F.col("replacement").contains(F.col("original")) & has_word("replacement")).select("original").distinct()
    return hit.select("record_id", "pii_type", "original").distinct().join(own, "original", "left_anti")


def surname_leaks(mapping: DataFrame, output: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Surnames of replaced people (two names, three letters, no common word of the document) that the output still holds."""
    names = F.regexp_extract_all("canonical", F.lit("[A-Za-z][A-Za-z'’-]*"), F.lit(0))
    last = mapping.where("pii_type = 'PERSON'").select("doc_id", names.alias("w")).where("size(w) >= 2").select("doc_id", F.lower(F.element_at("w", -1)).alias("surname")).where("length(surname) >= 3").distinct()
    rare = last.join(vocabulary.select("doc_id", F.col("word").alias("surname")), ["doc_id", "surname"], "left_anti")
    words = output.select("doc_id", "record_id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z][A-Za-z'’-]*"), F.lit(0)), F.lower))).alias("surname"))
    return words.join(rare, ["doc_id", "surname"]).select("doc_id", "record_id", "surname").distinct()


def differences(source: DataFrame, output: DataFrame, audited: DataFrame) -> DataFrame:
    """Records whose output is not their source with the audited replacements, is missing, or has no source."""
    spans = audited.groupBy("record_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "replacement"))).alias("r"))
    made = source.select("record_id", "text").join(spans, "record_id", "left").select("record_id", F.when(F.col("r").isNull(), F.col("text")).otherwise(rebuild(F.col("text"), F.col("r"))).alias("expected"))
    both = made.join(output.select("record_id", F.col("text").alias("found")), "record_id", "full_outer")
    return both.where(~F.col("expected").eqNullSafe(F.col("found")))


def stratified_sample(records: DataFrame, dense: int = 180, sections: tuple[tuple[int, int], ...] = (), prose: int = 150, seed: int = 42) -> DataFrame:
    """Records with their strata: A_dense the first ones and known sections, C_structured those with digits or labels, and
    B_prose a hash-ordered sample of the rest. Labels join with a plus."""
    is_dense = F.col("ord") < dense
    for low, high in sections:
        is_dense = is_dense | F.col("ord").between(low, high)
    sweep = F.col("text").rlike(r"@|(?i)\bwww\.|https?://|\+\s*91|\b(?:PAN|DIN|CIN|SEBI)\b|\p{Nd}{6}")
    marked = records.withColumns({"_a": is_dense, "_c": sweep})
    rest = marked.where("NOT _a AND NOT _c AND length(trim(text)) > 0").orderBy(F.sha2(F.concat_ws("\x01", F.lit(str(seed)), F.col("record_id")), 256)).limit(prose)
    label = F.concat_ws("+", F.when(F.col("_a"), "A_dense"), F.when(F.col("_c"), "C_structured"))
    return marked.where("_a OR _c").withColumn("stratum", label).unionByName(rest.withColumn("stratum", F.lit("B_prose"))).drop("_a", "_c")


def report(strict: DataFrame, relaxed: DataFrame, accuracy: DataFrame) -> str:
    """The metrics as Markdown; tables of a row for each type are brought to the driver."""
    out = ["# Detection quality"]
    for title, table in (("Strict", strict), ("Relaxed", relaxed)):
        out += ["", f"## {title}", "", "| type | tp | fp | fn | precision | recall | f1 | jaccard |", "|---|---|---|---|---|---|---|---|"]
        out += [f"| {r.pii_type} | {r.tp} | {r.fp} | {r.fn} | {r.precision:.3f} | {r.recall:.3f} | {r.f1:.3f} | {r.jaccard:.3f} |" for r in sorted(metrics(table).collect(), key=lambda r: (r.pii_type == "OVERALL", r.pii_type))]
    a = accuracy.first()
    return "\n".join([*out, "", f"Token accuracy: {a.accuracy:.4f} ({a.correct}/{a.total})", ""])

