"""The pipeline against plain Python, stage by stage, each on the stage's own input."""

import itertools
from collections import Counter, defaultdict

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from sediment.llm import line_dedup, packing, quality_rules
from sediment.llm.tables import table
from sediment.llm.text import word_list

DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, DIR, "documents"), []
    for name, f in P.STAGES:
        out.append((name, docs.toPandas()))
        docs = P.written(f(spark, docs, DIR), f"test-{name}")
    return out, docs.toPandas()


def rows(frame):
    return sorted(map(tuple, frame[COLUMNS].itertuples(index=False)))


def test_names_and_columns(stages):
    before, _ = stages
    assert [n for n, _ in before] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "packing"]
    assert all(list(f.columns) == COLUMNS for _, f in before)
    assert len(before[0][1]) > len(before[1][1]) >= len(before[2][1]) > len(before[3][1]) > 0


def test_rules_and_lines_equal_sql(stages):
    (_, documents), (_, good), (_, clean) = stages[0][:3]
    assert rows(good) == sorted(duckdb.sql(f"SELECT d.* FROM documents d JOIN ({quality_rules.score_sql('documents')}) USING (doc_id) WHERE keep").fetchall())
    want = duckdb.sql(line_dedup.clean_sql("good", columns="doc_id, kept AS text, lang, source, length(kept)::BIGINT AS n_chars")).fetchall()
    assert rows(clean) == sorted(r for r in want if r[1].strip(" \t\r\n"))
    assert len(documents)


def test_groups_equal_brute_force(stages):
    (_, before), (_, after) = stages[0][2], stages[0][3]
    sets = {}
    for d, t in zip(before.doc_id, before.text, strict=True):
        w = word_list(t)
        sets[d] = {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sorted(sets.items()), 2):
        if x and y and min(len(x), len(y)) * 2 >= max(len(x), len(y)) and len(x & y) / len(x | y) >= 0.5:
            root[find(b)] = find(a) if find(a) < find(b) else find(b)
            root[max(find(a), find(b))] = min(find(a), find(b))
    groups = defaultdict(list)
    for d in sets:
        groups[find(d)].append(d)
    assert sorted(after.doc_id) == sorted(min(g) for g in groups.values())
    assert set(rows(after)) <= set(rows(before))


def test_decontamination_equals_brute_force(spark, stages):
    (_, before), (_, after) = stages[0][3], stages[0][4]
    items = [w for r in table(spark, DIR, "benchmark").collect() if (w := word_list(r.text))]
    got = dict(zip(after.doc_id, after.text, strict=True))
    held = Counter(tuple(it[i : i + n]) for it in items for n in range(5, len(it) + 1) for i in range(len(it) - n + 1))
    shortest = {}
    for it in items:
        for n in range(5, len(it) + 1):
            for i in range(len(it) - n + 1):
                k = tuple(it[i : i + n])
                shortest[k] = min(shortest.get(k, 10**9), len(it))
    longest = max(map(len, items))
    touched = 0
    for d, t in zip(before.doc_id, before.text, strict=True):
        w, bad = word_list(t), set()
        for i in range(len(w)):
            for n in range(5, min(longest, len(w) - i) + 1):
                k = tuple(w[i : i + n])
                if k not in held:
                    break
                if n >= 13 or n >= 0.8 * shortest[k]:
                    bad |= set(range(i, i + n))
        if len(bad) > 0.5 * len(w):
            assert d not in got
        else:
            assert word_list(got[d]) == [x for i, x in enumerate(w) if i not in bad]
            assert bad or got[d] == t
        touched += bool(bad)
    assert touched >= 3


def test_windows_hold_every_token_once(stages):
    (_, docs), windows = stages[0][4], stages[1]
    cover = Counter((d, k) for ids, starts, sizes in zip(windows.doc_ids, windows.starts, windows.lengths, strict=True) for d, s, n in zip(ids, starts, sizes, strict=True) for k in range(s, s + n))
    tok = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    tok.encode_special_tokens = True
    want = {(d, k) for d, t in zip(docs.doc_id, docs.text, strict=True) if t for k in range(len(tok.encode(t, add_special_tokens=False).ids) + 1)}
    assert set(cover) == want and set(cover.values()) == {1}
    assert (windows.used + windows.slack == packing.CAPACITY).all() and (windows.slack >= 0).all()
    # each window that isn't a full one of a long document has the longest piece left, and no other pieces fill it better
    left = Counter(n for sizes in windows.lengths for n in sizes if n < packing.CAPACITY)
    for sizes in windows.sort_values(["lot", "window"]).lengths:
        if max(sizes) == packing.CAPACITY:
            continue
        top = max(left)
        room = packing.CAPACITY - top
        reach = 1
        for s in (left - Counter([top])).elements():
            reach |= reach << s & (1 << room + 1) - 1
        assert max(sizes) == top and sum(sizes) == top + reach.bit_length() - 1
        left -= Counter(sizes)
    assert not left


def test_run_gives_the_last_stage(spark, stages):
    got = P.run(spark, DIR).toPandas()
    key = lambda f: sorted((tuple(a), tuple(b), tuple(c)) for a, b, c in zip(f.doc_ids, f.starts, f.lengths, strict=True))
    assert key(got) == key(stages[1])
