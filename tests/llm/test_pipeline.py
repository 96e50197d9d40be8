from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
from conftest import prose
from pyspark.sql import functions as F
from test_near_duplicates import closure, slow_fingerprint
from test_rules import base
from test_tokens import check_packing

from voxelframe.llm import catalog, components, hamming, lines, packing, toxicity
from voxelframe.llm.common import scratch_so_far, shared_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, path):
    rude = "grumblefoot snarkwit dolthead"
    rows = []
    for k in range(240):
        text = f"Site menu\n{prose(k, 90)}\nwrite to a{k}@mail.example.com" + (f"\n{rude} {rude}" if k % 4 == 0 else "")
        rows.append((k, text, "en", f"s{k % 2}", len(text)))
    rows += [(300 + k, rows[1][1] + f"\nextra{k}", "en", "s1", 0) for k in range(6)] + [(400, None, None, None, None), (401, "", "en", "s0", 0), (402, "", "en", "s0", 0)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_each_stage_against_brute_force(spark, tmp_path):
    make(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "line_dedup", "simhash_near_dedup", "pii", "best_fit_packing"]
    text = {r.doc_id: r.text for r in docs.collect()}

    one = steps["toxicity"](spark, docs, str(tmp_path))
    assert one.columns == docs.columns
    kept = {r.doc_id: r for r in one.collect()}
    assert set(kept) == {k for k in text if k >= 240 or k % 4}  # rude ones go, clean ones stay

    two = steps["line_dedup"](spark, one, str(tmp_path))
    assert two.columns == docs.columns
    after = {r.doc_id: r for r in two.collect()}
    assert after.keys() == kept.keys() and after[400].text is None and after[400].n_chars is None
    by = defaultdict(list)
    for r in kept.values():
        by[r.source or ""].append(set(x.strip(" ") for x in (r.text or "").split("\n")))
    for i, r in after.items():
        pages = by[r.source or ""]
        bad = lambda x: x.strip(" ") and (n := sum(x.strip(" ") in p for p in pages)) > 1 and n > lines.RATIO * len(pages)  # noqa: B023, E731
        want = None if text[i] is None else "\n".join(x for x in text[i].split("\n") if not bad(x))
        assert r.text == want and (want is None or r.n_chars == len(want))
    assert "Site menu" not in after[1].text

    three = steps["simhash_near_dedup"](spark, two, str(tmp_path))
    assert three.columns == docs.columns
    ids = sorted(after)
    fp = np.array([slow_fingerprint(after[i].text or "") for i in ids], dtype=np.uint64)
    root = closure(len(ids), np.argwhere(np.triu(np.bitwise_count(fp[:, None] ^ fp[None]) <= 4, 1)).tolist())
    stays = {r.doc_id: r.text for r in three.collect()}
    assert sorted(stays) == [ids[k] for k in sorted(set(root))] and 400 in stays and 401 not in stays

    four = steps["pii"](spark, three, str(tmp_path))
    assert four.columns == docs.columns
    masked = {r.doc_id: r.text for r in four.collect()}
    for i, t in stays.items():
        want = t
        for a, _, b, kind in reversed(base(t or "")):
            want = want[:a] + f"<{kind}>" + want[b:]
        assert masked[i] == want
    assert "<email>" in masked[2]

    rows = steps["best_fit_packing"](spark, four, str(tmp_path)).collect()
    check_packing(rows, {i: [t or ""] for i, t in masked.items()})
    before = scratch_so_far()
    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert scratch_so_far() - before == {ran._scratch}  # nothing else is left behind
    ran = ran.collect()
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in ran) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows)


def test_odd_rows_and_clashing_names(spark, odd, none, tmp_path):
    make(spark, tmp_path)
    for start, n in ((odd, 10), (none, 0)):
        docs = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == start.columns, name
            docs = spark.createDataFrame(out.collect(), out.schema)
            assert docs.where("masked <> 'clash' or lines <> 'clash' or t <> 'clash' or toxic <> 'clash'").count() == 0
        assert (docs.count() > 0) == (n > 0)
        corpus_pipeline.pack(spark, docs, str(tmp_path)).count()


def test_queries_are_registered(spark):
    names = [n for n in catalog.QUERIES if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    d = "/root/testdata/sf0.001"
    out = catalog.QUERIES["op6_toxicity"](spark, d)
    assert dict(out.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    assert out.where((F.col("score") >= toxicity.REJECT).cast("int") != F.col("predicted")).count() == 0


def test_shared_folder_must_be_named_on_a_cluster():
    class Session:
        def __init__(self, **conf):
            self.values = {k.replace("__", "."): v for k, v in conf.items()}
            self.conf = self

        def get(self, key, default=None):
            return self.values.get(key, default)

        def set(self, key, value):
            self.values[key] = value

    assert shared_dir(Session(spark__master="yarn", spark__checkpoint__dir="hdfs:///x/")) == "hdfs:///x"
    assert shared_dir(Session(spark__master="local[4]")).startswith("file://")
    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,1024]", ""):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(Session(spark__master=master))


def test_one_python_worker_a_task(spark, tmp_path, monkeypatch):
    """Workers and daemons beyond one a core stay for all later stages: no task runs two Python functions, and no list of rows goes through Python."""
    make(spark, tmp_path)
    plans = []
    plain = components.saved

    def noted(df, what):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, what)

    def refused(*_a, **_k):
        raise AssertionError("rows went through Python workers")

    for module in (components, hamming, packing, toxicity):
        monkeypatch.setattr(module, "saved", noted)
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refused)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name in ("toxicity", "simhash_near_dedup", "best_fit_packing"):
        out = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        assert out.count()
    assert sum("MapInArrow" in p for p in plans) >= 5
    for plan in plans:
        running = 0
        for line in plan.split("\n"):
            running = 0 if "Exchange" in line or "Scan" in line else running + ("MapInArrow" in line)
            assert running < 2, plan
