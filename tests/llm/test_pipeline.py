"""The pipeline against plain Python, stage by stage, on a small table."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from jsonmill.llm.toxicity import fit, fold, hits

from .test_native import brute_hits
from .test_packing import check
from .test_simhash import brute_components, slow_fingerprint


@pytest.fixture(scope="module")
def stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, f in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.materialize(f(spark, out[-1], sf), f"test-{name}"))
    return sf, out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    _, out = stages
    assert all(d.columns == out[0].columns and d.dtypes == out[0].dtypes for d in out[1:5])


def test_toxicity(spark, stages):
    sf, out = stages
    model = fit(out[0], spark.read.parquet(f"{sf}/labels.parquet"))
    a, want = model.matcher(), set()
    for d, r in rows(out[0]).items():
        total, n = hits(a, fold(r.text))
        if model.score(total, len(fold(r.text).split()) if n else 1) < 0.5:
            want.add(d)
    assert rows(out[1]).keys() == want and len(want) < out[0].count()


def test_line_dedup(stages):
    _, out = stages
    before, after = rows(out[1]), rows(out[2])
    pages, lines = Counter(r.source for r in before.values()), Counter()
    for r in before.values():
        lines.update({(r.source, x.strip()) for x in r.text.split("\n") if x.strip()})
    gone = {k for k, n in lines.items() if n >= 5 and n > 0.03 * pages[k[0]]}
    assert gone and before.keys() == after.keys()
    for d, r in before.items():
        text = "\n".join(x for x in r.text.split("\n") if (r.source, x.strip()) not in gone)
        assert after[d].text == text and after[d].n_chars == len(text)


def test_near_dedup(stages):
    _, out = stages
    before, after = rows(out[2]), rows(out[3])
    group = brute_components([(d, slow_fingerprint(r.text)) for d, r in before.items()])
    assert after.keys() == set(group.values()) and len(after) < len(before)


def test_decontamination(spark, stages):
    sf, out = stages
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    found = brute_hits([(d, r.text) for d, r in rows(out[3]).items()], items)
    assert rows(out[4]).keys() == {d for d, x in found.items() if not x[1]}


def test_packing(stages):
    _, out = stages
    assert check(out[5].collect(), {d: r.text for d, r in rows(out[4]).items()}) < 0.01


def test_run_equals_the_stages(spark, stages):
    sf, out = stages
    count = lambda df: defaultdict(int, {r.doc_id: r["sum(length)"] for r in df.groupBy("doc_id").sum("length").collect()})
    assert count(corpus_pipeline.run(spark, sf)) == count(out[5])


NAMES = "n_lines N_Lines_Dropped text_before __bp_keys __BP_host __parts __left host key id label_id Toxic score n_hits fp component_id __gone __n bad __bad row h iv items c0 t start offset".split()


def test_columns_of_any_name_pass_through(spark):
    rows = [(k, None if k == 3 else f"Menu of the site\nline {k} of its own, with the words {k * 7} and {k * 11}", f"s{k % 2}", k, *[f"{n}-{k}" for n in NAMES]) for k in range(24)]
    rows.append((None, "Menu of the site", None, None, *[None] * len(NAMES)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        got = out.collect()
        assert got and all(r[n] == (None if r.doc_id is None else f"{n}-{r.doc_id}") for r in got for n in NAMES), name
        if name == "line_dedup":
            assert all(not r.text.startswith("Menu") and r.n_chars == len(r.text) for r in got if r.doc_id not in (3, None)) and len(got) == len(rows)
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
    assert corpus_pipeline.packing(spark, docs, "/root/testdata/sf0.001").select("doc_id").distinct().count() == len(rows)
