"""Quality rules, line dedup and licence scans: odd rows against expectations, and against their SQL in DuckDB."""

import duckdb
import pandas as pd
import pytest

from sediment.llm import license_scan, line_dedup, quality_rules
from sediment.llm.text import word_list

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, host string, bad string, row string, keep string, words int"
LONG = "The old house by the river was quiet and it stood there for years. " * 4000
BOILER = "Subscribe to our letter"
APACHE = "Intro.\nLicensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\nhttp://x\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\n"
TEXTS = [
    (1, "A clean and short one.", "s"),
    (1, "A clean and short one.", "s"),
    (2, None, "s"),
    (3, "", "s"),
    (4, " \n\t ", "s"),
    (5, LONG, "s"),
    (6, "BUY!! NOW!! CHEAP!! PILLS!!", "s"),
    (7, "no no no no no no no no", None),
    (8, "a | b | c | d | e | f\ng | h | i", ""),
    (9, "x" * 200, "s"),
    (10, "- one\n- two\n- three", "s"),
    (11, "wait...\nwell…\nso...", "s"),
    (12, "same line\nsame line\nsame line\nsame line", "s"),
    (None, APACHE, "s"),
    (13, "This work is licensed under the GNU General Public License, version 3. All rights reserved.", "s"),
    (14, "Unless required by applicable law", "s"),
    (15, "You may obtain a copy of the License at\nLicensed under the Apache License, Version 2.0", "s"),
]
TEXTS += [(100 + i, f"{BOILER}\nPage number {i} of this site\n  {BOILER} \n", "site") for i in range(12)]
TEXTS += [(200 + i, f"{BOILER}\nAnother page {i}", "other") for i in range(3)]


def frame(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "en" if i else None, s, len(t) if t else None, "h", "b", "r", "k", 1) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    docs = pd.DataFrame({"doc_id": pd.array([i for i, *_ in TEXTS], "Int64"), "text": [t for _, t, _ in TEXTS], "lang": ["en" if i else None for i, *_ in TEXTS], "source": [s for *_, s in TEXTS]})
    c.register("documents", docs)
    return c


def rows(got):
    return sorted((tuple(r) for r in got), key=str)


def same_as_sql(duck, got, sql):
    want = duck.execute(sql)
    columns = [d[0] for d in want.description]
    assert rows(got.select(*columns).collect()) == rows(want.fetchall())


def test_quality_rules(spark, duck):
    got = quality_rules.score(frame(spark))
    same_as_sql(duck, got, quality_rules.score_sql())
    failed = {r.doc_id: r.failed for r in got.collect()}
    assert {k for k, v in failed.items() if not v} >= {1, 13, 100, 200, None}
    assert {k: v for k, v in failed.items() if k in (2, 3, 4, 6, 7, 8, 9, 10, 11, 12)} == {
        2: "min_words", 3: "min_words", 4: "min_words", 6: "symbols", 7: "repeated_words", 8: "symbols", 9: "max_word_chars", 10: "bullet_lines", 11: "ellipsis_lines", 12: "repeated_lines",
    }
    kept = quality_rules.keep_good(frame(spark))
    assert kept.columns == frame(spark).columns and rows([(r.doc_id,) for r in kept.collect()]) == rows([(r.doc_id,) for r in got.where("keep").collect()])
    assert quality_rules.score(frame(spark).limit(0)).count() == quality_rules.keep_good(frame(spark).limit(0)).count() == 0


RUSSIAN = "Старый дом у реки стоял тихо много лет и никто не помнил его хозяина. " * 30
POLISH = "Stary dom nad rzeka stal cicho przez wiele lat i nikt nie pamietal jego pana. " * 30


def test_stop_words_judge_their_languages_only(spark):
    texts = [(1, RUSSIAN, "ru"), (2, RUSSIAN, None), (3, POLISH, "pl"), (4, "plum stone river " * 80, "en"), (5, "plum stone river " * 80, "de"), (6, LONG, "en")]
    d = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    assert {r.doc_id: r.failed for r in quality_rules.score(d).collect()} == {1: "", 2: "", 3: "", 4: "stop_words", 5: "stop_words", 6: ""}
    assert {r.doc_id for r in quality_rules.keep_good(d.withColumnRenamed("lang", "LANG")).collect()} == {1, 2, 3, 6}
    assert quality_rules.keep_good(d.drop("lang")).count() == 6


def test_rules_are_one_projection(spark):
    plan = quality_rules.score(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_line_dedup(spark, duck, monkeypatch):
    got = line_dedup.clean_lines(frame(spark))
    same_as_sql(duck, got, line_dedup.clean_sql())
    text = {r.doc_id: (r.text, r.n_lines, r.n_kept) for r in got.collect()}
    assert text[103] == ("Page number 3 of this site\n", 4, 2) and text[201][0].startswith(BOILER)
    assert text[2] == (None, 0, 0) and text[3] == ("", 0, 0) and text[5][0] == LONG and text[12][0].count("same") == 4
    out = line_dedup.drop_boilerplate(frame(spark))
    assert out.columns == frame(spark).columns and out.count() == len(TEXTS)
    assert {r.doc_id: r.n_chars for r in out.collect()}[103] == len(text[103][0])
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", -1)  # the shuffle join gives the same
    assert rows(line_dedup.clean_lines(frame(spark)).collect()) == rows(got.collect())
    assert line_dedup.clean_lines(frame(spark).limit(0)).count() == line_dedup.drop_boilerplate(frame(spark).limit(0)).count() == 0


def test_copies_are_no_boilerplate(spark):
    body = [f"Sentence {k} of a document that was copied around." for k in range(8)]
    near = [(i, "\n".join([BOILER, *body[:i], f"edit {i}", *body[i + 1 :]]), "h") for i in range(8)]
    exact = [(20 + i, "\n".join([BOILER, "A text in two lines that is there", "twelve times, each time the same."]), "h") for i in range(12)]
    pages = [(100 + i, f"{BOILER}\nPage number {i} of this host has its own words", "h") for i in range(60)]
    few = [(200 + i, f"A line of ten pages\nwith page {i} beside it, and a rest", "few") for i in range(10)] + [(300 + i, "one text, many times", "few") for i in range(400)]
    rows_ = near + exact + pages + few
    got = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(frame(spark, rows_)).collect()}
    want = {i: t.removeprefix(BOILER + "\n").removeprefix("A line of ten pages\n") for i, t, _ in rows_}
    assert got == want


def test_license_scan(spark, duck):
    got = license_scan.scan(frame(spark))
    same_as_sql(duck, got, license_scan.scan_sql())
    found = {r.doc_id: (r.sentences, r.licenses) for r in got.collect()}
    assert found == {
        None: ("apache2-by,apache2-use,apache2-copy,apache2-asis", "Apache-2.0,Apache-2.0-header"),
        13: ("gpl3-by,all-rights", "GPL-3.0,all-rights-reserved"),
        15: ("apache2-copy,apache2-by", "Apache-2.0"),
    }
    assert license_scan.scan(frame(spark, [(1, "you may not use this file except in compliance with the License", "s")])).first().licenses == "unknown-terms"
    assert license_scan.scan(frame(spark).limit(0)).count() == 0
    assert set(license_scan.known().values()) == set(license_scan.SENTENCES) and all(set(s) <= set(license_scan.SENTENCES) for _, s in license_scan.RULES)


def test_wrapped_licenses(spark):
    from textwrap import wrap

    said = {k: v[-1] for k, v in license_scan.SENTENCES.items()}
    mit = f"{said['mit-grant']}:\n\n{said['mit-notice']}.\n\n{said['mit-asis']}. IN NO EVENT SHALL THE AUTHORS BE LIABLE."
    bsd = f"{said['bsd-grant']}:\n\n1. {said['bsd-source']}.\n\n2. {said['bsd-binary']}."
    gpl = f"{said['gpl-free']}: {said['gpl-any']}.\n\nThis program is distributed in the hope that it will be useful."
    want = [(APACHE, "Apache-2.0,Apache-2.0-header"), (mit, "MIT-text"), (f"{said['isc-grant']}.", "ISC"), (bsd, "BSD-2-Clause-text"), (gpl, "GPL-3.0-or-later")]
    texts = [("\n".join(sign + x for part in t.split("\n") for x in wrap(part, width) or [""]), licence) for t, licence in want for width in (40, 76) for sign in ("", " * ", "// ", "# ", ";; ")]
    texts += [(t.replace("\n", "\r\n"), x) for t, x in texts]
    texts += [("Licensed under the\n\nMPL", None), ("You must not say that you are Licensed under the\nBSD License by us", None)]
    got = {r.doc_id: r.licenses for r in license_scan.scan(frame(spark, [(i, t, "s") for i, (t, _) in enumerate(texts)])).collect()}
    assert got == {i: x for i, (_, x) in enumerate(texts) if x}
    c = duckdb.connect()
    c.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": [t for t, _ in texts]}))
    assert dict(c.sql(f"SELECT doc_id, licenses FROM ({license_scan.scan_sql()})").fetchall()) == got


def test_every_known_sentence_is_found_and_sql_agrees(spark):
    said = [(name, w) for name, ws in license_scan.SENTENCES.items() for w in ws]
    assert len(said) > 900 and len(license_scan.known()) == len(said)
    texts = [f"Some words before it.\n{w}.\nAnd after it." for _, w in said] + [f"// {w}\n" for _, w in said[::7]] + [" ".join(w.split()[:-1]) + "\nx" for _, w in said[::9]]
    texts += ["Version: 2.0", "2.0", "I like the MIT License that they chose", "SPDX-License-Identifier: MIT-like"]
    d = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    got = {r.doc_id: r.sentences for r in license_scan.scan(d).collect()}
    assert {i: got.get(i) for i in range(len(said))} == {i: name for i, (name, _) in enumerate(said)}
    assert not {len(texts) - k for k in (1, 2, 3, 4)} & set(got)
    c = duckdb.connect()
    c.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    same_as_sql(c, license_scan.scan(d), license_scan.scan_sql())


def test_cut_wordings_need_all_parts(spark):
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
    texts = [mpl + " If a copy", mpl.replace("Public ", "Public\n"), mpl.replace("v. ", "v.\n"), "Rating: 2.0", "see v. 2.0.", "2.0"]
    got = {r.doc_id: r.licenses for r in license_scan.scan(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert got == dict.fromkeys(range(3), "MPL-2.0")


def test_stages_take_odd_rows(spark, tmp_path):
    import corpus_pipeline as P

    spark.createDataFrame([(1, "one two three four five six seven"), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (frame(spark), frame(spark).limit(0)):
        for name, stage in P.STAGES:
            after = P.written(stage(spark, docs, str(tmp_path)), f"odd-{name}")
            if name != "packing":
                assert after.columns == docs.columns and after.count() <= docs.count()
                docs = after
    left = {r.doc_id for r in P.written(P.STAGES[2][1](spark, frame(spark), str(tmp_path)), "odd").collect()}
    assert {1, 2, 3, 4, 5, 13, 14} <= left and word_list(LONG)
