"""Queries of workspace files, settings, conversions and workers (A17, A21, A22, G14, I16, K1, K2, K4, M2, M8, N2, N12, N13, N18)."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from rowloom.functions import sequences as S
from rowloom.operators import scoring
from rowloom.plans.registry import add, pairs, scratch, table
from rowloom.sources import readers, workspaces, writers

_TEXT = lambda c: F.col(c).cast("string")
#: Thirds of the peptides by a hash of their name, the same in both engines.
_THIRD = lambda: F.floor(S.hash_uniform(F.lit("42"), F.col("pep")) * 3)
_THIRD_SQL = "floor(('0x' || substr(md5('42|' || pep), 1, 13))::BIGINT::DOUBLE / 4503599627370496 * 3)"


def _refuses(write) -> bool:
    try:
        write()
    except (AnalysisException, FileExistsError):
        return True
    return False


def _cluster_map(s, d):
    path = scratch(s)
    workspaces.write_cluster_map(table(s, d, "part"), path, "p_size", "p_name", "epi_cluster")
    return workspaces.read_cluster_map(s, path).groupBy("cluster").agg(F.count("*").alias("members"), F.min("member").alias("first"))


add("A17_cluster_map", _cluster_map, "SELECT p_size AS cluster, count(DISTINCT p_name) AS members, min(p_name) AS first FROM part GROUP BY p_size")


def _folds(s, d):
    root, p = scratch(s), pairs(s, d).withColumn("fold", _THIRD()).select("pep", "ab", _TEXT("label").alias("label"), "fold")
    for k in range(3):
        writers.write_csv(p.where(F.col("fold") != k).drop("fold"), f"{root}/train_fold_{k}.csv")
        writers.write_csv(p.where(F.col("fold") == k).drop("fold"), f"{root}/val_fold_{k}.csv")
    writers.write_csv(p.drop("fold"), f"{root}/independent_set.csv")
    out = None
    for kind, k in [("independent", None), *((x, k) for k in range(3) for x in ("train", "val"))]:
        part = workspaces.read_fold(s, root, kind, k).groupBy().agg(F.count("*").alias("n"), F.sum(F.col("label").cast("int")).alias("positives"))
        part = part.select(F.lit(kind).alias("kind"), F.lit(-1 if k is None else k).alias("fold"), "n", "positives")
        out = part if out is None else out.unionByName(part)
    return out


add("A21_fold_files", _folds, f"WITH {{P}}, f AS (SELECT label, {_THIRD_SQL} AS f FROM pairs) SELECT 'independent' AS kind, -1 AS fold, count(*) AS n, sum(label) AS positives FROM f UNION ALL SELECT 'train', k, count(*) FILTER (WHERE f <> k), sum(label) FILTER (WHERE f <> k) FROM f, range(3) r(k) GROUP BY k UNION ALL SELECT 'val', k, count(*) FILTER (WHERE f = k), sum(label) FILTER (WHERE f = k) FROM f, range(3) r(k) GROUP BY k")


def _settings(s, d):
    """A settings file of a corpus's own sizes, an override, and a path that is found from the file's folder."""
    root = scratch(s)
    made = table(s, d, "orders").agg(F.count("*").alias("rows"), F.min("o_orderpriority").alias("reference")).select(F.to_json(F.struct("rows", "reference", F.lit(0.1).alias("fraction"), F.lit("data/train.csv").alias("input"))).alias("value"))
    made.coalesce(1).write.text(f"{root}/settings")
    found = workspaces.load_settings(s, f"{root}/settings", {"fraction": 0.25, "reference": None}, ("input",))
    return s.createDataFrame([(k, str(v).replace(root, "")) for k, v in sorted(found.items())], "setting string, value string")


add("A22_settings", _settings, "SELECT 'rows' AS setting, count(*)::VARCHAR AS value FROM orders UNION ALL SELECT 'reference', min(o_orderpriority) FROM orders UNION ALL SELECT 'fraction', '0.25' UNION ALL SELECT 'input', '/data/train.csv'")


def _gate(s, d):
    report = F.when(F.col("l_linenumber") == 1, F.to_json(F.struct("l_returnflag"))).otherwise(F.to_json(F.struct((F.col("l_linenumber") % 3).alias("split_protocol"))))
    return workspaces.protocol_gate(table(s, d, "lineitem").select(report.alias("report")), 1).groupBy("accepted", F.coalesce("reason", F.lit("current")).alias("why")).agg(F.count("*").alias("n"))


add("G14_protocol_gate", _gate, "SELECT why = 'current' AS accepted, why, count(*) AS n FROM (SELECT CASE WHEN l_linenumber = 1 THEN 'missing' WHEN l_linenumber % 3 <> 1 THEN 'legacy' ELSE 'current' END AS why FROM lineitem) GROUP BY why")


def _widths(s, d):
    rows = pairs(s, d).select("kind", S.pad(F.upper(F.replace("pep", F.lit(" "), F.lit(""))), 30).alias("p"), S.pad(F.col("grp"), 12).alias("r")).distinct()
    joined = rows.select("kind", S.with_separator(F.col("r"), F.col("p"), spaced=True).alias("text"))
    tokens = joined.withColumn("tokens", F.split("text", " "))
    return S.same_width(tokens, "tokens", ["kind"]).join(joined.groupBy("kind").agg(F.min("text").alias("first")), "kind")


add("I16_separated_batches", _widths, "WITH {P}, r AS (SELECT DISTINCT kind, rpad(upper(replace(pep, ' ', '')), 30, 'X') AS p, rpad(grp, 12, 'X') AS r FROM pairs), t AS (SELECT kind, rtrim(regexp_replace(r || '|' || p, '(.)', '\\1 ', 'g')) AS text FROM r) SELECT kind, count(*) AS n, min((length(text) + 1) // 2)::INT AS width, min(text) AS first FROM t GROUP BY kind")


def _csv_once(s, d):
    path = scratch(s)
    rows = pairs(s, d).groupBy("brand").agg(F.count("*").alias("n"))
    writers.write_csv(rows, path)
    refused = _refuses(lambda: writers.write_csv(rows, path))
    return readers.read_strings(s, path).select("brand", F.col("n").cast("long").alias("n"), F.lit(refused).alias("refused"))


add("K1_csv_refuses", _csv_once, "{P} SELECT brand, count(*) AS n, TRUE AS refused FROM pairs GROUP BY brand")


def _workspace(s, d):
    """Splits by peptide behind the leak gate, the pool, the blocked pairs and the report, read back; a leaking set is refused."""
    path, p = scratch(s), pairs(s, d).withColumn("third", _THIRD()).select("pep", "ab", "grp", "label", "third")
    parts = {name: p.where(F.col("third") == k).drop("third") for k, name in enumerate(("train", "valid", "test"))}
    pool, blocked = p.select("ab").distinct(), p.where("label = 1").select("pep", "ab").distinct()
    report = {"rows": {k: v.count() for k, v in parts.items()}, "pool": pool.count()}
    writers.write_workspace({**parts, "pool": pool, "blocked": blocked}, path, report, ["pep"])
    leaked = False
    try:
        writers.write_workspace({"train": parts["train"], "valid": parts["train"]}, f"{path}-leak", report, ["pep"])
    except ValueError:
        leaked = not readers.path_exists(s, f"{path}-leak/train")
    told = json.loads(s.read.text(f"{path}/report").first()[0])
    out = None
    for name in (*parts, "pool", "blocked"):
        part = s.read.parquet(f"{path}/{name}").agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n", F.lit(told["rows"].get(name, told["pool"] if name == "pool" else None)).cast("long").alias("reported"), F.lit(leaked).alias("leak_refused"))
        out = part if out is None else out.unionByName(part)
    return out


add("K2_workspace", _workspace, f"WITH {{P}}, t AS (SELECT *, {_THIRD_SQL} AS third FROM pairs), n AS (SELECT CASE third WHEN 0 THEN 'train' WHEN 1 THEN 'valid' ELSE 'test' END AS part, count(*) AS n, count(*) AS reported FROM t GROUP BY third UNION ALL SELECT 'pool', count(DISTINCT ab), count(DISTINCT ab) FROM t UNION ALL SELECT 'blocked', count(*), NULL FROM (SELECT DISTINCT pep, ab FROM t WHERE label = 1)) SELECT *, TRUE AS leak_refused FROM n")


def _report(s, d):
    path = scratch(s)
    rows = pairs(s, d).groupBy("kind").agg(F.count("*").alias("n"), F.sum("label").alias("positives")).collect()  # a row per kind
    writers.write_report(s, {r.kind: {"n": r.n, "positives": r.positives} for r in rows}, path)
    refused = False
    try:
        writers.write_report(s, {"auroc": float("nan")}, f"{path}-nan")
    except ValueError:
        refused = not readers.path_exists(s, f"{path}-nan")
    found = s.read.text(path).select(F.explode(F.from_json("value", "map<string, struct<n: bigint, positives: bigint>>")).alias("kind", "v"))
    return found.select("kind", "v.n", "v.positives", F.lit(refused).alias("nan_refused"))


add("K4_json_report", _report, "{P} SELECT kind, count(*) AS n, sum(label)::BIGINT AS positives, TRUE AS nan_refused FROM pairs GROUP BY kind")


def _linear(asked):
    return lambda frame: frame["p_size"] * float(asked["weight"]) + frame["p_name"].str.len()


def _worker(s, d):
    rows = table(s, d, "part").select(F.col("p_partkey").alias("row_id"), "p_name", "p_size")
    out = scoring.run_worker(rows, {"stage": "predict", "weight": 0.5, "threshold": 20}, _linear)
    return out.select("row_id", "score", (F.col("score") >= F.col("threshold")).cast("int").alias("predicted_label"))


add("M2_worker_stage", _worker, "SELECT p_partkey AS row_id, p_size * 0.5::DOUBLE + length(p_name) AS score, (p_size * 0.5::DOUBLE + length(p_name) >= 20)::INT AS predicted_label FROM part")


def _gathered(s, d):
    rows = table(s, d, "orders").select(F.col("o_orderkey").alias("row_id"), "o_totalprice")
    shards = [scoring.evaluation_shard(rows, k, 4).select("row_id", F.lit(k).alias("rank"), F.round(F.col("o_totalprice") * 2, 2).alias("score")) for k in range(4)]
    return scoring.gathered(shards)


add("M8_gathered_shards", _gathered, "SELECT o_orderkey AS row_id, (o_orderkey % 4)::INT AS rank, round(o_totalprice * 2, 2) AS score FROM orders")


def _split_files(s, d):
    root, p = scratch(s), pairs(s, d).withColumn("third", _THIRD()).select("pep", "ab", "label", "third")
    for k, name in enumerate(("train", "valid", "test")):
        writers.write_csv(p.where(F.col("third") == k).drop("third"), f"{root}/{workspaces.SPLIT_FILES[name].format(fold=0)}")
    out = None
    for drawn in (False, True):
        for name, df in workspaces.read_splits(s, root, ["pep", "ab"], positives_only=drawn).items():
            part = df.agg(F.count("*").alias("n"), F.sum("label").alias("positives")).select(F.lit(name).alias("split"), F.lit(drawn).alias("drawn_negatives"), "n", "positives")
            out = part if out is None else out.unionByName(part)
    return out


add("N2_split_files", _split_files, f"WITH {{P}}, t AS (SELECT label, CASE {_THIRD_SQL} WHEN 0 THEN 'train' WHEN 1 THEN 'valid' ELSE 'test' END AS split FROM pairs) SELECT split, FALSE AS drawn_negatives, count(*) AS n, sum(label)::BIGINT AS positives FROM t GROUP BY split UNION ALL SELECT split, TRUE, sum(label)::BIGINT, sum(label)::BIGINT FROM t GROUP BY split")


def _converted(s, d):
    """Both modes, each refused where its output exists."""
    root = scratch(s)
    p = pairs(s, d).select("pep", "ab", _TEXT("label").alias("label"), "l_returnflag")
    for flag in ("A", "R"):
        writers.write_csv(p.where(F.col("l_returnflag") == flag).drop("l_returnflag"), f"{root}/fold_{flag}.csv")
    identity = (f"{root}", ["fold_A", "fold_N", "fold_R"])  # there is no fold_N
    resolver = lambda x: (x.where("label = 1"), x.where("label = 0"))
    domains = (pairs(s, d).select("pep", "ab", "label"), resolver)
    out = None
    for mode, source, name in (("identity", identity, "one"), ("domains", domains, "two")):
        path = workspaces.convert(s, mode, source, f"{root}/{name}")
        refused = _refuses(lambda m=mode, x=source, q=path: workspaces.convert(s, m, x, q))
        for part in ("",) if mode == "identity" else ("/positive_records", "/exclusions"):
            rows = readers.read_strings(s, path + part).agg(F.count("*").alias("n")).select(F.lit(mode + part).alias("file"), "n", F.lit(refused).alias("refused"))
            out = rows if out is None else out.unionByName(rows)
    return out


add("N12_converted", _converted, "{P} SELECT 'identity' AS file, count(*) FILTER (WHERE label = 1 AND l_returnflag IN ('A', 'R')) AS n, TRUE AS refused FROM pairs UNION ALL SELECT 'domains/positive_records', sum(label)::BIGINT, TRUE FROM pairs UNION ALL SELECT 'domains/exclusions', sum(1 - label)::BIGINT, TRUE FROM pairs")


def _defaults(s, d):
    """Defaults of the workspaces that the flags stand for; the one of returned items has its batch size given."""
    rows = []
    for r in sorted(table(s, d, "lineitem").groupBy("l_returnflag").count().collect()):  # a row per flag
        report = {"A": {"level": "III"}, "N": {"level": "IV"}, "R": {"backend": "pan-esm2", "level": "IV"}}[r.l_returnflag]
        rows += [(r.l_returnflag, k, v, r["count"] // v) for k, v in workspaces.training_defaults(report, batch_size=5 if r.l_returnflag == "R" else None).items()]
    return s.createDataFrame(rows, "workspace string, setting string, value long, steps long")


add("N13_training_defaults", _defaults, "SELECT l_returnflag AS workspace, setting, value::BIGINT AS value, count(*) // value AS steps FROM lineitem JOIN (VALUES ('A', 'batch_size', 24), ('A', 'patience', 4), ('A', 'gradient_accumulation_steps', 2), ('N', 'batch_size', 8), ('N', 'patience', 4), ('N', 'gradient_accumulation_steps', 6), ('R', 'batch_size', 5), ('R', 'patience', 5), ('R', 'gradient_accumulation_steps', 1)) v(flag, setting, value) ON flag = l_returnflag GROUP BY l_returnflag, setting, value")


def _binding():
    return lambda frame: (frame["cdr3"].str.len() * 3 + frame["epitope"].str.len()) / 64.0


def _bindings(s, d):
    path = scratch(s)
    rows = pairs(s, d).select(S.last_part(F.col("ab")).alias("cdr3"), F.col("pep").alias("epitope"))
    workspaces.predict_and_write(rows, _binding, path)
    return readers.read_strings(s, path).groupBy("cdr3", "epitope").agg(F.count("*").alias("n"), F.round(F.sum(F.col("binding").cast("double")), 6).alias("binding"))


add("N18_binding_file", _bindings, "{P} SELECT split_part(ab, '/', 2) AS cdr3, pep AS epitope, count(*) AS n, round(sum((length(split_part(ab, '/', 2)) * 3 + length(pep)) / 64::DOUBLE), 6) AS binding FROM pairs GROUP BY ALL")
