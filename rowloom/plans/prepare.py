"""The dataset plan: corpora and a fixed test set to leakage-free workspaces.

Order is part of the result: the test set is taken out of every corpus first, one validation block is chosen from the
reference corpus and taken out of all, negatives are drawn last, against everything known. What later steps must not
compute again is cut into the checkpoint folder.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.functions import sequences as S
from rowloom.operators import joins, negatives, neighbors, records, splits
from rowloom.operators.components import checkpoint_dir, stored
from rowloom.schema import CLUSTER_EDITS, PAIR_COLUMNS, Caps, require_columns

#: Reports of another version were made under other rules.
PROTOCOL = 1
_KEY = ["pep", "mhc", "grp"]


@dataclass(frozen=True)
class Config:
    reference: str
    grouping: str = "pair_stratified"
    fraction: float = 0.1
    seed: int = 42
    level: str = "III"
    mhc_class: str = "I"
    caps: Caps | None = None

    @classmethod
    def load(cls, path: str, **overrides) -> Config:
        """From a JSON file; overrides that aren't None win; unknown names are an error."""
        with open(path) as f:
            found = json.load(f) | {k: v for k, v in overrides.items() if v is not None}
        if unknown := set(found) - {x.name for x in fields(cls)}:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**found).checked()

    def checked(self) -> Config:
        if self.grouping not in splits.GROUPINGS or not 0 < self.fraction < 1:
            raise ValueError("grouping or fraction out of range")
        return replace(self, caps=self.caps or Caps.of(self.level, self.mhc_class))


def check_protocol(report: dict) -> dict:
    if report.get("protocol") != PROTOCOL:
        raise ValueError(f"workspace of protocol {report.get('protocol')}, this is {PROTOCOL}")
    return report


def _with_keys(df: DataFrame) -> DataFrame:
    """pep normalized; mhc and grp are the keys of the pair."""
    require_columns(df, PAIR_COLUMNS)
    return df.withColumns({"pep": S.norm(F.col("pep")), "mhc": S.norm(F.col("hla_allele")), "grp": S.endpoint_group(F.coalesce(F.col("cdr3_ab"), F.col("ab")) if "cdr3_ab" in df.columns else F.col("ab"))})


def prepare(corpora: dict[str, DataFrame] | DataFrame, test: DataFrame, config: Config) -> dict[str, dict]:
    """Per corpus: train, valid, test, pool, blocked as DataFrames, and report as a dict.

    corpora: by name, or one DataFrame that has the name in `corpus`, so that a table with several is read once. All go through each
    step together. What is shut out of a draw is the table of blocked pairs, with the donors' places.
    """
    config = config.checked()
    checkpoint_dir(test.sparkSession)
    reasons = records.capability_reasons(config.caps)
    columns = ["pep", "hla", "hla_allele", "ab", "label", "mhc", "grp"]
    order = ["ab", "hla", "hla_allele", "label"]
    bad = F.lit(False)
    for reason in reasons:
        bad = bad | F.col(reason)
    test = stored(records.with_reasons(_with_keys(test), reasons).select(*columns, *reasons))
    if not test.where(bad).isEmpty():
        raise ValueError("the fixed test set has rows that the model can't represent")
    test = stored(records.dedup_evaluation(test.select(*columns), _KEY, "label", order))
    every = None
    for df in [corpora] if isinstance(corpora, DataFrame) else [df.withColumn("corpus", F.lit(name)) for name, df in corpora.items()]:
        df = _with_keys(df).where("corpus IS NOT NULL").select("corpus", *columns)
        every = df if every is None else every.unionByName(df)
    marked = records.with_reasons(every, reasons)  # reasons are kept, so the corpora are read once
    on = {"pair_stratified": _KEY, "peptide": ["pep"], "cluster": ["cluster"]}[config.grouping]
    if config.grouping == "cluster":
        marked = stored(marked)
        good = marked.where(~bad).select("corpus", *columns)
        clusters = stored(neighbors.single_linkage(good.select("pep").unionByName(test.select("pep")).distinct(), "pep", CLUSTER_EDITS))
        available = stored(joins.not_in_keys(good.join(clusters, "pep"), test.join(clusters, "pep"), on))
    else:
        held = test.select(*on, F.lit(True).alias("__held")).distinct()
        marked = stored(marked.join(held, on, "left"))
        available = marked.where(~bad & F.col("__held").isNull()).select("corpus", *columns)
    counts = marked.groupBy("corpus").agg(F.count_if(bad).alias("excluded"), *[F.count_if(F.col(reason)).alias(reason) for reason in reasons])
    counts = {r.corpus: r for r in counts.collect()}  # a row per corpus
    names = sorted(counts) if isinstance(corpora, DataFrame) else list(corpora)

    source = available.where(F.col("corpus") == config.reference).drop("corpus")
    if config.grouping == "pair_stratified":
        has = {name: f"__has{i}" for i, name in enumerate(names)}
        among = {c: F.col("corpus") == name for name, c in has.items()} | {"__in": F.col("corpus") == config.reference}
        keys = stored(available.groupBy(*_KEY).agg(*[F.max(c.cast("int")).alias(n) for n, c in among.items()]))
        quotas = splits.pair_quotas(keys.where("__in = 1").select(*_KEY), config.fraction, config.seed)
        positives = source.join(splits.chosen_pairs(keys, quotas, list(has.values()), config.seed), _KEY, "left_semi")
    else:
        positives = joins.in_keys(source, splits.group_validation(source, on[0], config.fraction, config.seed), on)
    positives = stored(records.keep_first(positives, _KEY, order))
    cleaned = stored(joins.not_in_keys(available, positives, on).select(*columns, "corpus"), "corpus")

    known = None
    for df in (cleaned, positives, test):  # whose ab is never null: such a row can't be represented
        known = df.select("pep", "ab") if known is None else known.unionByName(df.select("pep", "ab"))
    donors = negatives.numbered_donors(known)
    groups = known.select("pep", S.endpoint_group(F.col("ab")).alias("__grp")).distinct()
    blocked = stored(groups.join(donors, "__grp").select("pep", "ab", "place"))  # each once, as a donor has one group; every known pair is there
    wanted = positives.select("pep", "hla", "hla_allele", "mhc", F.col("grp").alias("__for"))
    shut = blocked if config.grouping == "pair_stratified" else blocked.join(positives.select("pep").distinct(), "pep", "left_semi")
    drawn = stored(negatives.negatives_by_place(wanted, donors, shut, config.seed + 1000))
    without = drawn.where("ab IS NULL").count()
    drawn = drawn.where("ab IS NOT NULL")
    drawn = drawn.withColumns({"label": F.lit(0), "grp": S.endpoint_group(F.col("ab"))}).select(*columns)
    valid = stored(records.keep_first(positives.select(*columns).unionByName(drawn), _KEY, [F.desc("label"), "ab"]))

    out, tested = {}, test.count()
    labels = {str(r.label): r["count"] for r in valid.groupBy("label").count().collect()}
    per = cleaned.groupBy("corpus", *_KEY).agg(F.count("*").alias("n")).groupBy("corpus").agg(F.sum("n").alias("n"), F.count("*").alias("unique"))
    per = {r.corpus: (r.n, r.unique) for r in per.collect()}  # a row per corpus
    for name in names:
        n, unique = per.get(name, (0, 0))
        found = counts[name].asDict() if name in counts else {}
        report = {"protocol": PROTOCOL, "excluded": found.get("excluded", 0), "reasons": {reason: found.get(reason, 0) for reason in reasons}}
        report |= {"train": n, "train_unique": unique, "train_repeats": n - unique, "valid": dict(labels), "positives_without_donor": without, "test": tested, "grouping": config.grouping, "seed": config.seed}
        train = cleaned.where(F.col("corpus") == name).select(*columns)
        out[name] = {"train": train, "valid": valid, "test": test.select(*columns), "pool": donors.select("ab"), "blocked": blocked.select("pep", "ab"), "report": report}
    return out
