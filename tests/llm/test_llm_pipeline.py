"""The pipeline against a plain-Python version of its five stages, and each stage on odd rows."""

import base64
import hashlib
import os
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline
from parityspark.llm import op2_language_id, op6_quality_rules
from parityspark.llm.catalog import callables, oracles

WORDS = {
    "en": "river mill child morning light bird stone house winter window garden paper copper letter summer teacher bridge market yellow silver".split(),
    "de": "fluss mühle kinder morgen licht vogel steine häuser winter fenster garten papier kupfer briefe sommer lehrer brücke märkte gelbes silber".split(),
}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(lang, seed, n=90):
    rng = np.random.default_rng(seed)
    w = [WORDS[lang][i] + (WORDS[lang][j] if k % 3 else "") for k, (i, j) in enumerate(rng.integers(0, 20, (n, 2)))]
    return " ".join(w).capitalize() + "."


def corpus():
    rows = [(i, sentence("en" if i % 3 else "de", i), "en" if i % 3 else "de") for i in range(60)]
    rows += [(100 + i, rows[i][1], rows[i][2]) for i in range(5)] + [(0, rows[0][1], rows[0][2])]  # copies and a repeated row
    rows += [(110, rows[6][1] + " one more", "de"), (111, rows[7][1].replace("river", "rivers"), None)]
    rows += [(120 + i, " ".join(w.upper() + "!!" for w in sentence("en", 500 + i).split()), "en") for i in range(4)]
    rows += [(130, "too short", "en"), (131, None, None), (132, "", "en"), (133, ("same words again " * 60).strip(), "en"), (134, " ".join("###" for _ in range(90)), "en")]
    rows += [(None, sentence("de", 900), "de"), (140, sentence("en", 901, 20_000), "en")]
    bench = [(1, " ".join(rows[10][1].split()[20:34])), (2, rows[12][1].lower().replace(" ", "\n")), (3, None), (4, "never seen here at all")]
    return rows, bench


def shingles(t, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    return frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, bench):
    # Quality rules: same votes and model over patterns, counted here one by one.
    measured = [dict(zip(op6_quality_rules.COUNTS, op6_quality_rules.measure(t.encode() if t is not None else None))) for _, t, _ in rows]
    votes = [tuple(op6_quality_rules.vote_of(r, m) for r in op6_quality_rules.RULES) for m in measured]
    model = op6_quality_rules.fit(Counter(votes), len(op6_quality_rules.RULES))
    good = [r for r, m, v in zip(rows, measured, votes) if m["n_words"] >= 50 and 100 * m["n_repeat_words"] <= 50 * m["n_words"] and model.log_odds(v) >= 0]
    # Languages here are told apart without fail and every text is like its language; only texts without letters could go.
    good = [r for r in good if re.search(r"[^\W\d_]", r[1])]
    sets = [shingles(t) for _, t, _ in good]
    root = list(range(len(good)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(good)):
        for b in range(a):
            same = good[a][0] is not None and good[a][0] == good[b][0]
            linked = sets[a] == sets[b] or (None not in (good[a][0], good[b][0]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
            if same or linked:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    groups = defaultdict(list)
    for i in range(len(good)):
        groups[find(i)].append(good[i])
    kept = []
    for members in groups.values():
        ids = [m[0] for m in members if m[0] is not None]
        kept += [m for m in members if m[0] is None]
        if ids:
            kept.append(min((m for m in members if m[0] == min(ids)), key=lambda m: m[1]))
    cut = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    windows = {tuple(w[i : i + 10]) for _, t in bench for w in [cut(t)] if w for i in range(max(1, len(w) - 9))}
    clean = []
    for r in kept:
        w = cut(r[1])
        if not any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1)):
            clean.append(r)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for i, t, _ in clean:
        ids = encoding.encode_ordinary(t)
        out.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows, bench = corpus()
    frame = spark.createDataFrame([(i, t, lang, "src0", None if t is None else len(t)) for i, t, lang in rows], SCHEMA).repartition(3)
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, bench


def test_pipeline_equals_plain_python(spark, tables):
    folder, rows, bench = tables
    got = sorted(str(tuple(r)) for r in corpus_pipeline.run(spark, folder).collect())
    want = sorted(str(r) for r in brute(rows, bench))
    assert got == want and 30 < len(want) < len(rows)


def test_stages_keep_the_columns_of_documents(spark, tables):
    folder, rows, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns, name
        nothing = stage(spark, docs.limit(0), folder)
        assert nothing.count() == 0 and nothing.columns == docs.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "ngram_jaccard", "decontamination", "byte_bpe"]


def test_language_stage_keeps_all_clean_texts(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet").filter("length(text) > 200")
    assert op2_language_id.keep(docs, op2_language_id.with_floors(docs, op2_language_id.train(docs))).count() == docs.filter("doc_id <> 134 OR doc_id IS NULL").count()


def test_every_operator_has_its_query():
    names = list(callables())
    assert sorted({int(n[2:].split("_")[0]) for n in names}) == list(range(1, 14)) and set(oracles()) <= set(names)


SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")
@pytest.mark.parametrize("name", sorted(oracles()))
def test_query_equals_its_sql(spark, name):
    from tools.check import compare, connect

    rows, problem = compare(spark, connect(SF_DIR), SF_DIR, callables()[name], oracles()[name])
    assert problem is None and rows > 0


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")
def test_result_columns_of_the_contracts(spark):
    want = {
        "op1_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op2_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
        "op4_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
        "op5_byte_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
        "op6_quality_rules": {c: "bigint" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")} | {"doc_id": "bigint", "base_failed": "boolean", "kept": "boolean"},
        "op7_ngram_jaccard": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
        "op9_decontamination": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
        "op10_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    }
    for name, columns in want.items():
        got = dict(callables()[name](spark, SF_DIR).dtypes)
        assert columns.items() <= got.items(), (name, got)
