"""Each operator against a brute-force version, and on null, empty, long, tied, repeated and clashing input."""

import random
import re
import time
import tracemalloc
import unicodedata
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import components, decontaminate, html_text, language, licenses, mixing, near_dedup, quality_model, quality_rules, sharding, textkit, toxicity
from siltstone.llm.queries import ORACLE_SQL, QUERIES
from siltstone.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words_of(text, fold=False):
    data = (text or "").encode()
    return (data.lower() if fold else data).split()


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty values in every column, a very long text, ties, repeated rows and clashing extra columns."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (None, "the null id of a text with several words", "en", "b", 5),
        (4, "one two three", None, "b", 9), (5, long, "en", None, 9), (6, "the same text is here and there again", "en", "c", 1), (7, "the same text is here and there again", "en", "c", 1),
        (8, "repeated row of the table with words", "de", "d", 1), (8, "repeated row of the table with words", "de", "d", 1), (9, "12345 !!! 678", "en", "a", 2),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for clash in ("size", "score", "rank", "label", "component_id", "shard", "slot", "n", "a", "b", "target", "kept", "__text"):
        df = df.withColumn(clash, F.lit(1))
    return df


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def none(df):
    return df.limit(0)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_gives_the_same_rows(spark, name):
    got = QUERIES[name](spark, SF)
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    answer = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in answer.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(repr([dict(zip(names, r, strict=True))[c] for c in sorted(names)]) for r in answer.fetchall())
    assert sorted(repr([r[c] for c in sorted(names)]) for r in got.collect()) == want


# 1: mixing


def test_mix_meets_targets(docs, texts):
    rows = [r.asDict() for r in mixing.mix_digest(docs).collect()]
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    taken, target, sizes = Counter(), {}, Counter()
    for r in rows:
        s = source[r["doc_id"]]
        taken[s], target[s] = taken[s] + r["taken"], r["target"]
        sizes[s] += r["size"]
        assert r["size"] == len(WORD.findall(texts[r["doc_id"]])) and 0 <= r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - target[s]) <= 1 and target[s] <= 3 * sizes[s] + 1e-6 for s in target)
    assert abs(sum(target.values()) - sum(sizes.values())) < 1e-3
    level = {s: target[s] / (5, 2, 1)[i % 3] for i, s in enumerate(sorted(target))}
    free = [level[s] for s in target if target[s] < 3 * sizes[s] - 1e-6]
    assert max(free) - min(free) < 1e-4 and all(level[s] <= max(free) + 1e-4 for s in target)


def test_schedule_inverts_its_own_integral(spark):
    schedule = mixing.Schedule((0.0, 0.3, 1.0), ((1.0, 5.0, 2.0), (2.0, 2.0, 2.0), (0.0, 4.0, 0.0)))
    for c, row in enumerate(schedule.weights):
        times = spark.range(101).select(schedule.time_of(F.lit(c), F.col("id") / 100).alias("t")).collect()
        for i, r in enumerate(times):
            grid = np.linspace(0, r["t"], 20_001)
            done = np.trapezoid(np.interp(grid, schedule.times, row), grid) / schedule.integral(row)
            assert abs(done - i / 100) < 1e-5


def test_mix_of_odd_rows(odd):
    rows = mixing.mix_digest(odd).collect()
    assert len(rows) == odd.count() and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert next(r for r in rows if r["doc_id"] == 1)["size"] == 0
    assert mixing.mix_digest(none(odd)).count() == 0
    mixed = mixing.mixed(odd)
    assert mixed.columns == odd.columns and mixing.mixed(none(odd)).count() == 0


def test_whole_draws_stay_near_targets(docs):
    drawn = mixing.mixed(docs).groupBy("source").agg(F.sum(mixing.word_count()).alias("n")).collect()
    plan = {r["source"]: r["t"] for r in mixing.plan_mix(docs, mixing.word_count()).groupBy(F.substring("__key", 2, 99).alias("source")).agg(F.max("__target").alias("t")).collect()}
    longest = max(len(WORD.findall(r["text"])) for r in docs.collect())
    assert all(abs(r["n"] - plan[r["source"]]) <= longest for r in drawn)


def test_equal_rows_are_split_and_drawn_one_after_the_other(spark, monkeypatch):
    """A third of all rows are one document without an id, in more parts than one."""
    monkeypatch.setattr(mixing, "CHUNK", 64)
    monkeypatch.setattr(mixing, "CHUNK_BITS", 3)
    monkeypatch.setattr(mixing, "CELL_ROWS", 4)
    rows = [(None, "the very same text of it", "a")] * 300 + [(i, "words of " + "its own " * (i % 7), "ab"[i % 2]) for i in range(600)] + [(None, f"no id {i}", "b") for i in range(50)] + [(None, "", "b")] * 5
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(6)
    got = mixing.mix_digest(docs).collect()
    taken = Counter()
    assert len(got) == len(rows)
    source = {r["source_size"]: r["target"] for r in got}
    for r in got:
        taken[r["source_size"]] += r["taken"]
        assert r["taken"] <= 3 * r["size"]
    assert all(abs(taken[k] - t) <= 1 for k, t in source.items()) and len(source) == 2
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = con.execute(ORACLE_SQL["op1_mix_curriculum"]).fetchall()
    names = [c[0] for c in con.description]
    assert Counter(tuple(r[c] for c in sorted(names)) for r in got) == Counter(tuple(dict(zip(names, w, strict=True))[c] for c in sorted(names)) for w in want)
    drawn = mixing.mixed(docs).groupBy("source").agg(F.sum(mixing.word_count()).alias("n")).collect()
    sizes = Counter()
    for _, text, s in rows:
        sizes[s] += len(WORD.findall(text))
    longest = max(len(WORD.findall(t)) for _, t, _ in rows)
    assert all(abs(r["n"] - source[sizes[r["source"]]]) <= longest for r in drawn)


# 2: pages


def test_page_text_is_the_article(spark):
    page = """<html><head><title>T</title><style>x</style></head><body><header><h1>Site</h1></header><nav><ul><li>Home</li></ul></nav>
    <div class="cookie-notice">We use cookies</div><article><h1>A &amp; B</h1><p>First  para\n with <b>bold</b>&nbsp;words<br>and a line.<p>Second one, <a href="/x">linked</a>.
    <div class="ad">Buy</div><script>var a = "</p><p>no";</script><ul><li>item 1</li><li>item 2</li></ul><form><input>Name</form></article>
    <section id="comments"><p>Great post, thanks for writing it.</p></section><aside>Related</aside><footer>&copy; us</footer></body></html>"""
    weights = html_text.learn_weights(spark.read.parquet(f"{SF}/pages.parquet"))
    assert html_text.extract(page, weights) == "A & B\nFirst para with bold words and a line.\nSecond one, linked.\nitem 1\nitem 2"
    assert html_text.extract(page.replace("article>", "div>"), weights).startswith("A & B\nFirst para")
    assert html_text.extract(None, weights) == html_text.extract("", weights) == html_text.extract("<p></p>", weights) == ""


class Plain(HTMLParser):
    """The text of the first marked element by the standard library's parser: blocks, white space, references."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.lines, self.inside = [], [""], 0

    def handle_starttag(self, tag, attrs):
        names = dict(attrs).get("class", "")
        if tag in html_text.BLOCKS:
            self.lines.append("")
        if tag == "br" and self.inside:
            self.lines[-1] += " "
        if tag not in html_text.VOID:
            self.open.append((tag, tag in html_text.NEVER or names == "ad"))
            self.inside += tag in html_text.MARKED

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass
            self.inside -= tag in html_text.MARKED
        if tag in html_text.BLOCKS:
            self.lines.append("")

    def handle_data(self, data):
        if self.inside and not any(never for _, never in self.open):
            self.lines[-1] += data


def test_whole_pages_against_the_standard_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_text.page_texts(pages).collect()}
    marked = [r for r in pages.collect() if r["html"] and re.search("<(article|main)", r["html"])]
    assert len(marked) > 100 and len(got) == pages.count()
    for r in marked:
        plain = Plain()
        plain.feed(r["html"])
        want = (re.sub(r"\s+", " ", line).strip() for line in plain.lines)
        assert got[r["page_id"]] == "\n".join(line for line in want if line), r["page_id"]


def test_best_run_is_the_maximum():
    rng = np.random.default_rng(3)
    for _ in range(50):
        x = rng.integers(-3, 4, 12).astype(float)
        a, b = html_text.best_run(x)
        best = max([0.0] + [x[i:j].sum() for i in range(12) for j in range(i + 1, 13)])
        assert x[a:b].sum() == best


def test_pages_of_odd_rows(spark):
    rows = [(1, None, None), (2, "u", ""), (2, "u", ""), (3, "v", "<p>" + "long text " * 50_000), (None, "w", "<<>><p>a<b")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit(0))
    got = html_text.page_texts(pages).collect()
    assert len(got) == 5 and [r["n_chars"] for r in got if r["page_id"] in (1, 2)] == [0, 0, 0]
    assert next(r for r in got if r["page_id"] == 3)["n_chars"] == 10 * 50_000 - 1
    assert html_text.page_texts(none(pages)).count() == 0


# 3: licences


def test_full_texts_win_over_mentions(spark):
    apache = "Licensed under the Apache License, Version 2.0 (the License);\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at x\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS.\nSee the License for the specific language governing permissions and limitations under the License."
    rows = [(1, apache), (2, "RELEASED under the *MIT* License!! and Licensed under CC BY-NC 4.0."), (3, "A license to fish is permission."), (4, None), (5, ""), (2, "Released under the MIT License")]
    got = sorted((r["doc_id"], r["license"], r["n_matches"]) for r in licenses.licenses(spark.createDataFrame(rows, "doc_id int, text string").withColumn("rule", F.lit(9))).collect())
    assert got == [(1, "Apache-2.0", 1), (2, "CC-BY-NC-4.0", 1), (2, "MIT", 1), (2, "MIT", 1)]


def test_every_sentence_has_a_cue_and_an_opener():
    for name, text in licenses.SENTENCES:
        assert re.search(licenses.CUES, text), name
        assert text.startswith(licenses.OPENERS), name


GNU = """Copyright (C) 2001 Somebody. All rights reserved.
This {what} is free software{colon} you can redistribute it and/or modify it under the terms of the {name} as published by
the Free Software Foundation{comma} {either}version {version} of the License{later}.

This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.

You should have received a copy of the {name} along with this {what}. If not, see <https://www.gnu.org/licenses/>."""
LATER = {"either": "either ", "later": ", or (at your option) any later version", "comma": ","}
PROVIDED = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY'
BSD = """Copyright 2008, Google Inc.
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:
    * Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
    * Redistributions in binary form must reproduce the above copyright notice, this list of conditions in the documentation.
{more}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."""
NEITHER = "    * Neither the name of Google Inc. nor the names of its\n contributors may be used to endorse or promote products derived from this software."
NOTICES = {
    "MIT": f"The MIT License (MIT)\n\nCopyright (c) 2011 Somebody. All rights reserved.\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files\nto deal in the Software.\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{PROVIDED}",
    "BSD-3-Clause": BSD.format(more=NEITHER),
    "BSD-2-Clause": BSD.format(more=""),
    "BSD-4-Clause": BSD.format(more="3. All advertising materials mentioning features or use of this software must display the following acknowledgement.\n" + NEITHER),
    "ISC": 'ISC License\n\nCopyright (c) 2004\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above\ncopyright notice appears.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications",
    "Unlicense": f"This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy. {PROVIDED}",
    "BSL-1.0": f"Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation.\n\n{PROVIDED}",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an "AS IS" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nSee the License for the specific language governing permissions and\nlimitations under the License.',
    "GPL-3.0-or-later": GNU.format(what="program", colon=":", name="GNU General Public License", version="3", **LATER),
    "GPL-2.0": GNU.format(what="file", colon=";", name="GNU General Public License", version="2", either="", later="", comma=";"),
    "LGPL-2.1-or-later": GNU.format(what="library", colon=";", name="GNU Lesser General Public License", version="2.1", **LATER),
    "LGPL-3.0-or-later": GNU.format(what="library", colon=":", name="GNU Lesser General Public License", version="3", **LATER),
    "AGPL-3.0-or-later": GNU.format(what="program", colon=":", name="GNU Affero General Public License", version="3", **LATER),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
}
SHORT = {
    "Licensed under MIT": "MIT", "License: MIT": "MIT", "Distributed under the MIT License": "MIT", "This is made available under the terms of the Apache License 2.0.": "Apache-2.0", "// SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0",
    "Released under the GPLv3": "GPL-3.0", "licensed under the GNU General Public License (GPL) version 3": "GPL-3.0", "Licensed under the GNU GPL": "GPL", "Published under a BSD 3-Clause license": "BSD-3-Clause", "licensed under the 2-clause BSD license": "BSD-2-Clause",
    "Licensed under CC BY-NC-SA 3.0": "CC-BY-NC-SA-3.0", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "CC-BY-SA-4.0", "Released under CC0": "CC0-1.0", "License: Apache-2.0": "Apache-2.0",
    "distributed under the Unlicense": "Unlicense", "Licensed under the LGPL v2.1": "LGPL-2.1", "licenced under the mozilla public licence version 2.0": "MPL-2.0", "SPDX-License-Identifier: Zlib": "Zlib", "All rights reserved.": "proprietary",
}


def test_each_notice_gives_its_licence_alone(spark):
    want = {text: {lic} for lic, text in NOTICES.items()} | {text: {lic} for text, lic in SHORT.items()}
    clean = ["a permit under the microscope", "He was released under mitigating terms", "The general public licensed the apache helicopter under protest", "version 3 of the story", "it is distributed under pressure"]
    want |= dict.fromkeys(clean, set())
    texts = list(want)
    got = defaultdict(set)
    rows = licenses.licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    for r in rows:
        got[texts[r["doc_id"]]].add(r["license"])
    assert {t: got[t] for t in texts} == want
    assert all(r["n_matches"] == 1 for r in rows) and len(rows) == len(NOTICES) + len(SHORT)


EXPRESSIONS = {
    "Licensed under either of Apache License, Version 2.0 or MIT license at your option.": {"Apache-2.0", "MIT", "OR"},
    "SPDX-License-Identifier: MIT OR Apache-2.0": {"MIT", "Apache-2.0", "OR"},
    "// SPDX-License-Identifier: (GPL-2.0-only OR MIT)": {"GPL-2.0", "MIT", "OR"},
    "SPDX-License-Identifier: MIT OR Apache-2.0 OR BSD-3-Clause": {"MIT", "Apache-2.0", "BSD-3-Clause", "OR"},
    "SPDX-License-Identifier: GPL-2.0-or-later": {"GPL-2.0-or-later"},
    "SPDX-License-Identifier: LGPL-2.1-or-later AND BSD-2-Clause": {"LGPL-2.1-or-later", "BSD-2-Clause", "AND"},
    "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0": {"GPL-2.0", "Classpath-exception-2.0"},
    "SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception": {"Apache-2.0", "LLVM-exception"},
    "Licensed under the GPLv2+": {"GPL-2.0-or-later"},
    "Released under the GNU GPL version 3 or any later version": {"GPL-3.0-or-later"},
    "Distributed under the GNU General Public License v2 or, at your option, any later version.": {"GPL-2.0-or-later"},
    "This is dual licensed under the MIT and the Apache 2.0 licenses": {"MIT", "Apache-2.0", "AND"},
    "This code is not licensed under the MIT license": set(),
    "It is no longer released under the GPL": set(),
    "never distributed under the terms of the Apache License 2.0": set(),
    "Licensed under the Artistic License 2.0": {"Artistic-2.0"},
    "SPDX-License-Identifier: 0BSD": {"0BSD"},
    "Released under the WTFPL": {"WTFPL"},
    "Each contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable patent license": {"patent-grant"},
    "They met at MIT or Apache headquarters and also or else": set(),
}


def test_expressions_of_licences(spark):
    texts = list(EXPRESSIONS)
    got = {t: set() for t in texts}
    for r in licenses.licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect():
        got[texts[r["doc_id"]]].add(r["license"])
    assert got == EXPRESSIONS


def test_licences_equal_their_sql(spark):
    con = duckdb.connect()
    texts = [*NOTICES.values(), *SHORT, *EXPRESSIONS, "\n".join(NOTICES.values()), None, "", "Released under MIT. " * 3]
    con.execute("CREATE TABLE documents (doc_id INTEGER, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    got = licenses.licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(licenses.LICENSE_SQL).fetchall())


def test_licences_of_odd_rows(odd):
    assert licenses.licenses(odd).count() == 0 and licenses.licenses(none(odd)).count() == 0


# 4: language


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.language_digest(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_rows(odd):
    rows = language.language_digest(odd).collect()
    assert len(rows) == odd.count()
    assert {r["doc_id"] for r in rows if r["lang_pred"] == "und"} == {1, 2, 3, 9}
    assert language.language_digest(none(odd)).count() == 0
    kept = language.with_known_language(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()}.isdisjoint({1, 2, 3, 9})


def test_windows_hold_the_whole_text():
    raw = np.frombuffer(("abc" * 200 + "xyz").encode(), np.uint8)
    windows, doc = language.text_windows(raw, np.array([0, 600, 600, 603]))
    assert doc.tolist() == [0, 0, 0, 1, 2]
    assert (windows.ravel() > 0).sum() == 603


def test_network_equals_a_direct_convolution():
    """Responses by look-up equal filters slid over one-hot symbols, place by place."""
    rng = np.random.default_rng(8)
    k = language.FILTERS
    filters = {w: rng.normal(size=(w, language.N_SYMBOLS, k)).astype(np.float32) for w in language.WIDTHS}
    dense = rng.normal(size=(k * len(language.WIDTHS) + 1, 3)).astype(np.float32)
    windows = rng.integers(0, language.N_SYMBOLS, (5, language.WINDOW))
    got = language.ByteCNN(["a", "b", "c"], filters, dense).probabilities(windows)
    for x, p in zip(windows, got, strict=True):
        one_hot = np.eye(language.N_SYMBOLS, dtype=np.float32)[x]
        pooled = [np.max([(one_hot[i : i + w, :, None] * filters[w]).sum(axis=(0, 1)) for i in range(language.WINDOW - w + 1)], axis=0) for w in language.WIDTHS]
        scores = np.append(np.maximum(np.concatenate(pooled), 0), 1) @ dense
        want = np.exp(scores - scores.max()) / np.exp(scores - scores.max()).sum()
        assert np.allclose(p, want, atol=1e-4)


def test_many_languages_are_all_learned(spark, monkeypatch):
    """Sixty languages, more than the sample has room for at the usual number of documents each."""
    monkeypatch.setattr(language, "DOCS_OF_ALL", 120)
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} words " * 5, f"l{i % 60:02}") for i in range(600)]
    model = language.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert model.classes == [f"l{i:02}" for i in range(60)]


def test_documents_stay_where_no_language_is_known(spark, odd):
    kept = language.with_known_language(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r["doc_id"] for r in kept.collect()} == {None, 4, 5, 6, 7, 8} and kept.columns == odd.columns


# 5: quality rules


def counts_by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered)


def test_quality_counts(spark, docs, odd):
    for df in (docs, odd):
        by_id = defaultdict(set)
        for r in df.collect():
            by_id[r["doc_id"]].add(counts_by_hand(r["text"]))
        rows = quality_rules.quality_rules(spark, df).collect()
        assert len(rows) == df.count()
        for r in rows:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) in by_id[r["doc_id"]]
            assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    assert quality_rules.quality_rules(spark, none(odd)).count() == 0


def em_by_hand(votes):
    """(share, bad, good) by rule from a list of {rule: vote}, and each text's probability, in arrays."""
    q, rules = quality_rules, sorted({r for v in votes for r in v})
    said_bad, said_good = (np.array([[v.get(r) == x for r in rules] for v in votes], float).reshape(len(votes), len(rules)) for x in (0, 1))
    bad, good, share = np.full(len(rules), q.FIRST_BAD), np.full(len(rules), q.FIRST_GOOD), q.FIRST_SHARE

    def chance():
        of_bad = (1 - share) * np.prod(np.where(said_bad, bad, np.where(said_good, 1 - bad, 1)), axis=1)
        of_good = share * np.prod(np.where(said_bad, 1 - good, np.where(said_good, good, 1)), axis=1)
        return of_good / (of_bad + of_good)

    for _ in range(q.ROUNDS):
        p = chance()
        voted = said_bad + said_good
        was = np.concatenate([bad, good])
        bad = ((1 - p) @ said_bad + q.STRENGTH * q.FIRST_BAD) / ((1 - p) @ voted + q.STRENGTH)
        good = (p @ said_good + q.STRENGTH * q.FIRST_GOOD) / (p @ voted + q.STRENGTH)
        pooled = said_bad.sum(0) / np.maximum(voted.sum(0), 1)
        idle = bad < 1 - good
        bad, good = (np.clip(np.where(idle, x, y), q.LEAST_RATE, 1 - q.LEAST_RATE) for x, y in ((pooled, bad), (1 - pooled, good)))
        share = min(max((p.sum() + q.STRENGTH * q.FIRST_SHARE) / (len(votes) + q.STRENGTH), q.LEAST_SHARE), q.MOST_SHARE)
        if abs(np.concatenate([bad, good]) - was).max() < 1e-6:
            break
    return share, dict(zip(rules, bad, strict=True)), dict(zip(rules, good, strict=True)), chance()


def test_accuracies_by_hand(spark):
    """EM over vote patterns equals the same over single texts in plain Python."""
    rules = ["x", "y", "z"]
    data = [(0, None, None, 30), (None, 0, None, 20), (None, None, 1, 200), (1, None, 1, 90), (0, 0, None, 9), (0, 0, 1, 13), (1, 1, 0, 25), (None, None, None, 40)]
    got = quality_rules.estimate(spark.createDataFrame(data, "v_x int, v_y int, v_z int, n bigint"), rules)
    share, bad, good, _ = em_by_hand([dict(zip(rules, v, strict=True)) for *v, n in data for _ in range(n)])
    assert abs(got.share - share) < 1e-6
    assert all(abs(got.bad[r] - bad[r]) < 1e-5 and abs(got.good[r] - good[r]) < 1e-5 for r in rules)


def prose(n, symbols=0, salt=0):
    return " ".join([f"word{chr(97 + (i + salt) % 26)}{chr(97 + (i * 7 + salt) % 25)}{chr(97 + i // 25)}" for i in range(n - symbols)] + ["#"] * symbols)


def test_accuracies_decide_what_is_kept(spark, monkeypatch):
    """The same text with a fault and good votes is kept or not, as the rules are held to be right."""
    docs = spark.createDataFrame([(1, prose(100, 15)), (2, prose(100))], "doc_id int, text string")
    kept = []
    for bad, good in ((0.9, 0.999), (0.2, 0.85)):
        monkeypatch.setattr(quality_rules, "estimate", lambda patterns, rules, b=bad, g=good: quality_rules.Accuracies(0.9, dict.fromkeys(rules, b) | dict.fromkeys(set(rules) - {"symbols", "letters"}, 0.5), dict.fromkeys(rules, g) | dict.fromkeys(set(rules) - {"symbols", "letters"}, 0.5)))
        kept.append({r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark, docs).collect()})
    assert kept == [{1: False, 2: True}, {1: True, 2: True}]


def votes_by_hand(text):
    n, chars, symbols, dup, repeats = counts_by_hand(text)
    text = text or ""
    words, lines = WORD.findall(text), sum(bool(WORD.search(x)) for x in text.split("\n"))
    letters = sum(unicodedata.category(c)[0] == "L" for c in text)
    plain = sum(bool(w.rstrip(".,;:!?") == w or len(w.rstrip(".,;:!?")) == len(w) - 1) and all(unicodedata.category(c)[0] == "L" for c in w.rstrip(".,;:!?")) and w.rstrip(".,;:!?") != "" for w in words)
    distinct, runs, capitals = len(set(words)), sum(a == b for a, b in zip(words, words[1:], strict=False)), sum("A" <= c <= "Z" for c in text)
    shouts, marks = text.count("!"), sum(c in ".?!" for c in text)
    m, x, long = max(n, 1), max(chars, 1), max(n, 1) >= 2000
    limits = {
        "symbols": (10 * symbols > m, 100 * symbols <= m), "plain": (10 * plain < 7 * m, 10 * plain >= 9 * m), "letters": (10 * (chars - letters) > x, 20 * (chars - letters) <= x),
        "lines": (4 * dup > lines and dup > 2, lines >= 3 and dup == 0), "repeats": (100 * repeats > 15 * m, m >= 50 and repeats == 0), "runs": (5 * runs > m, 100 * runs <= 3 * m),
        "variety": (10 * distinct < 4 * m and not long, long or 2 * distinct >= m), "lengths": (x > 12 * m or x < 3 * m, 4 * m <= x <= 8 * m),
        "capitals": (4 * capitals > x, 1000 * capitals >= 3 * x and 100 * capitals <= 8 * x), "sentences": (marks == 0 and m >= 60, 3 * m <= 100 * marks <= 20 * m), "shouts": (100 * shouts > 17 * m, False),
    }
    return {rule: 0 if bad else 1 if good else None for rule, (bad, good) in limits.items()}


def test_verdicts_by_hand(spark):
    """Votes, expectation-maximisation and posterior in plain Python over a whole table; verdicts go against bad votes and against good ones."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    odd = [(-1, None), (-2, ""), (-3, prose(12)), (-4, "SHOUT! " * 30), (-5, prose(100, 15)), (-6, "same same " * 60), (-7, "a1 b2 c3 d4 " * 9)]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id bigint, text string"))
    rows = quality_rules.quality_rules(spark, docs).join(docs, "doc_id").collect()
    passing = [r for r in rows if not r["base_failed"]]
    votes = [votes_by_hand(r["text"]) for r in passing]
    *_, chance = em_by_hand(votes)
    for r, v, p in zip(passing, votes, chance, strict=True):
        assert abs(r["posterior"] - p) < 1e-4 and r["kept"] == (r["posterior"] >= 0.5), (r["doc_id"], v)
    overruled = sum(r["kept"] and 0 in v.values() for r, v in zip(passing, votes, strict=True))
    outvoted = sum(not r["kept"] and sum(x == 1 for x in v.values()) > sum(x == 0 for x in v.values()) for r, v in zip(passing, votes, strict=True))
    assert overruled >= 5 and outvoted >= 20, (overruled, outvoted)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    known = [(r["kept"], labels[r["doc_id"]]) for r in passing if labels.get(r["doc_id"]) is not None]
    assert np.mean([k for k, good in known if good]) > 0.99 and np.mean([k for k, good in known if not good]) < 0.1


def test_estimated_accuracies_depend_on_the_corpus(spark):
    """A fault is forgiven where it comes alone, and not where it comes with others."""
    clean = [(i, prose(100, salt=i)) for i in range(100, 400)]
    worse = [(i, " ".join([prose(60, 30, salt=i), *(f"{j}A#" for j in range(40))])) for i in range(500, 560)]
    lined = [(i, "\n".join([prose(8, salt=i)] * 2 + [prose(12, salt=i + 3 * j) for j in range(6)])) for i in range(600, 640)]
    rows = spark.createDataFrame(clean + worse + lined, "doc_id int, text string")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark, rows).collect()}
    assert all(kept[i] for i, _ in clean + lined) and not any(kept[i] for i, _ in worse)


# 6 and 8: learned scores


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_model.quality_digest(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity_digest(spark, docs, labels).join(labels, "doc_id").where("held_out").collect()
    clean = [r for r in rows if r["toxic"] == 0]
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.9 and np.mean([r["predicted"] for r in clean]) < 0.05


@pytest.mark.parametrize("column", ["quality", "toxic"])
def test_scores_of_odd_rows(spark, odd, docs, column):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (5, 1, 0), (None, 1, 1), (6, None, None)], "doc_id bigint, quality int, toxic int")
    run = (lambda d, x: quality_model.quality_digest(d, x)) if column == "quality" else (lambda d, x: toxicity.toxicity_digest(spark, d, x))
    for some in (labels, none(labels)):
        rows = run(odd, some).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    assert run(none(odd), labels).count() == 0


def damerau(a, b):
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_automaton_equals_edit_distance():
    rng = np.random.default_rng(0)
    terms = sorted({"".join(rng.choice(list("abc"), rng.integers(2, 7))) for _ in range(40)})
    trie = toxicity.Trie(terms)
    for _ in range(200):
        word = "".join(rng.choice(list("abc"), rng.integers(1, 8)))
        assert sorted(k for k, _ in toxicity.within_one(word, trie)) == [k for k, t in enumerate(terms) if damerau(word, t) <= 1]


def test_quotation_counts_less_than_abuse():
    lexicon = toxicity.Lexicon({"idiot": 3.0}, {}, {"idiot"})
    abuse, quoted, clean = (lexicon.features(t)[1] for t in ("you are an idiot and that is all there is", 'the report said that "idiot" is a word that was used once', "a quiet day at the lake"))
    assert abuse > quoted > clean == 0
    assert lexicon.features("such an id1ot!")[1] > 0 and lexicon.look_up("idoit.") == (3.0 * toxicity.NEAR_PART, 1)


def test_branches_find_all_near_terms():
    rng = np.random.default_rng(4)
    terms = {"".join(rng.choice(list("abcd"), rng.integers(3, 9))): 2.0 for _ in range(60)}
    lexicon = toxicity.Lexicon(terms, {}, set(terms))
    for _ in range(400):
        word = "".join(rng.choice(list("abcd"), rng.integers(2, 10)))
        assert sorted(t for t, _ in lexicon.near_terms(word)) == sorted(t for t in terms if len(t) >= toxicity.FUZZY_LENGTH and damerau(word, t) <= 1)


def test_texts_with_misspelled_terms_alone(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    calm = "the weather was fine and we walked along the river until evening, then had dinner with friends before going home. "
    texts = {-1: calm, -2: calm + "you are such an idoit and a lsoer", -3: calm + "worthlss pathteic clwon", -4: calm + 'it was said that "idiot" is a rude word'}
    more = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity_digest(spark, docs.select("doc_id", "text").unionByName(more), labels).where("doc_id < 0").collect()}
    assert got == {-1: 0, -2: 1, -3: 1, -4: 0}


def test_misspelled_words_are_their_terms(spark):
    """A frequent term, rarer forms of it that are no entries of their own, and one that is too frequent for that."""
    plain = [(0, f"plain words number{i % 7} here") for i in range(300)]
    forms = {"grobnax": 40, "grobnix": 8, "gorbnax": 6, "grobnaxx": 5, "grobnux": 25}
    rows = plain + [(1, f"some {w} there") for w, n in forms.items() for _ in range(n)]
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "label int, text string"))
    assert {"grobnax", "grobnux"} <= set(lexicon.terms) and not {"grobnix", "gorbnax", "grobnaxx"} & set(lexicon.terms)
    assert lexicon.near["grobnax"] > 0
    for word in ("grobnix", "gorbnax", "grobnaxx", "grobmax"):
        assert "grobnax" in dict(lexicon.near_terms(word))


def misspell(word, rng):
    """One error inside a word of five letters or more: a letter is wrong, missing, extra or swapped with the next."""
    i = rng.randrange(1, len(word) - 2)
    return rng.choice([word[:i] + "z" + word[i + 1 :], word[:i] + word[i + 1 :], word[:i] + "q" + word[i:], word[:i] + word[i + 1] + word[i] + word[i + 2 :]])


def test_the_automata_decide_misspelled_texts(spark):
    """Held-out toxic texts with every whole term of theirs misspelled: found by the automata, and not without them."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    lexicon, weights = toxicity.train(spark, docs, labels)
    without = toxicity.Lexicon(lexicon.terms, lexicon.stems, set())
    held = docs.join(labels, "doc_id").where(language.held_out(F.col("doc_id"), 4, 2)).select("doc_id", "text", "toxic").collect()
    rng = random.Random(43)
    seeds = re.compile(r"\b(" + "|".join(t for t in toxicity.SEED_TERMS if len(t) >= 5) + r")\b", re.I)
    score = lambda lex, text: 1 / (1 + np.exp(-np.dot(weights, lex.features(text))))
    toxic = [r for r in held if r["toxic"] == 1 and len(seeds.findall(r["text"] or "")) >= 2 and "scum" not in r["text"]]
    spoiled = [seeds.sub(lambda m: misspell(m[0], rng), r["text"]) for r in toxic]
    found = np.mean([score(lexicon, t) >= toxicity.THRESHOLD for t in spoiled])
    alone = np.mean([score(without, t) >= toxicity.THRESHOLD for t in spoiled])
    assert len(toxic) >= 20 and found >= 0.9 and alone <= 0.4, (len(toxic), found, alone)
    clean = [r["text"] for r in held if r["toxic"] == 0]
    assert np.mean([score(lexicon, t) >= toxicity.THRESHOLD for t in clean]) < 0.01


def test_kernel_of_dual_descent_separates():
    rng = np.random.default_rng(1)
    rows = [np.unique(np.concatenate([[5 if y else 9], rng.integers(20, 400, 12)])).astype(np.int32) for y in (0, 1) * 60]
    model = quality_model.NBSVM.fit(rows, np.array((0, 1) * 60))
    score = model.probability(model.margins(np.concatenate(rows), np.cumsum([0] + [len(r) for r in rows])))
    assert ((score > 0.5) == np.array((0, 1) * 60, bool)).mean() > 0.97


def test_dual_descent_reaches_the_least_hinge_loss():
    """No small step from the fitted weights lowers the primal objective, which is that of a plain subgradient's best."""
    rng = np.random.default_rng(3)
    rows = [np.unique(np.concatenate([[5 if y else 9], rng.integers(20, 60, 6)])) for y in rng.integers(0, 2, 60)]
    labels = np.array([1 if 5 in r else 0 for r in rows])
    labels[:6] = 1 - labels[:6]
    model = quality_model.NBSVM._margins(rows, labels, 1.0, 400, 5)
    x = np.zeros((len(rows), 61))
    for i, r in enumerate(rows):
        x[i, r] = quality_model.scaled(model.ratio[r])
    x[:, 60], sign = 1, np.where(labels == 1, 1.0, -1.0)
    cost = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))

    def loss(w):
        return w @ w / 2 + cost @ np.maximum(0, 1 - sign * (x @ w))

    got = np.append(model.weights[:60], model.bias)
    w, best = np.zeros(61), np.inf
    for t in range(20_000):
        inside = sign * (x @ w) < 1
        w = w - (w - x.T @ (cost * sign * inside)) / (t + 2)
        best = min(best, loss(w))
    assert loss(got) <= best * 1.001
    assert all(loss(got) <= loss(got + rng.normal(0, 0.01, 61)) + 1e-9 for _ in range(100))


def test_indicators_by_hand():
    """Set indicators of a text do not hang on its neighbours, and long texts pack into a fixed size."""
    texts = ["Aa bb, aa bb! cc", "", "x", "Aa bb, aa bb! cc"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    at, bounds = quality_model.features(raw, np.cumsum([0] + [len(t) for t in texts]))
    alone = [quality_model.features(*one_text(t))[0].tolist() for t in texts]
    assert [r.tolist() for r in np.split(at, bounds[1:-1])] == alone and alone[0] == alone[3] and len(alone[1]) == 1
    many = quality_model.features(*one_text(" ".join(f"w{i}" for i in range(60_000))))[0]
    for row in (many, at[bounds[0] : bounds[1]]):
        assert len(quality_model.packed(row)) <= quality_model.N_FEATURES // 8 and np.array_equal(quality_model.unpacked(quality_model.packed(row)), row)


def test_long_texts_teach(spark):
    """Labelled texts of any length are learned from: all of these are longer than 30,000 characters."""
    texts = [(i, " ".join(f"{'good' if i % 2 else 'bad'}{j % 7} w{(i * 31 + j) % 997}" for j in range(3600))) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    rows = quality_model.quality_digest(docs, labels).collect()
    assert min(len(t) for _, t in texts) > 30_000 and all(r["predicted"] == r["doc_id"] % 2 for r in rows)


# 7: decontamination


def tiles_by_hand(doc, item, least):
    """Greedy string tiling by trying every pair of places."""
    used_d, used_i, covered = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and i + n not in used_i and d + n not in used_d:
                    n += 1
                best = max(best, (n, -d, -i))
        n, d, i = best[0], -best[1], -best[2]
        if n < least:
            return covered
        used_d.update(range(d, d + n))
        used_i.update(range(i, i + n))
        covered += n


def test_tiling_by_hand():
    rng = np.random.default_rng(5)
    for _ in range(60):
        item = [f"w{x}" for x in rng.integers(0, 6, rng.integers(5, 25))]
        cut = int(rng.integers(1, len(item)))
        doc = [f"w{x}" for x in rng.integers(0, 6, 10)] + item[cut:] + ["zz"] + item[:cut]
        items, words = decontaminate._Items([7], [" ".join(item)]), textkit.Words(*one_text(" ".join(doc)), textkit.NOT_ALNUM)
        found = list(items.matches(words.hash, items.known(words.shingles(decontaminate.MIN_MATCH, short=False)[0])))
        want = tiles_by_hand(doc, item, decontaminate.MIN_MATCH)
        assert (found[0][2] if found else 0) == (want if want >= decontaminate.COVERAGE * len(item) else 0)


def test_tiling_of_long_repeats_is_bounded():
    words = np.full(100_000, 7, np.uint64)
    tracemalloc.start()
    tiles = decontaminate.tile(words, words[:400])
    assert tiles == [(0, 0, 400)] and tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
    items = decontaminate._Items([1, 2], ["a b c " * 100, "a b c d e f g h"])
    doc = textkit.Words(*one_text("a b c " * 30_000), textkit.NOT_ALNUM)
    found = list(items.matches(doc.hash, items.known(doc.shingles(decontaminate.MIN_MATCH, short=False)[0])))
    assert found == [(1, 300, 300, 1, 300, 1.0)]


def one_text(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return raw, np.array([0, len(raw)])


def test_leaks_are_found_reordered_and_dressed(spark, monkeypatch):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu"
    a, b = " ".join(item.split()[:6]), " ".join(item.split()[6:])
    rows = [(1, f"start {item} end"), (2, f"{b} and then {a}"), (3, f"{a.upper()}, {b}!"), (4, "alpha beta gamma and nothing else"), (5, None), (6, ""), (None, item), (1, f"start {item} end")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("item_id", F.lit(0)).withColumn("coverage", F.lit(0))
    items = spark.createDataFrame([(10, item), (11, None), (12, "too short"), (None, item)], "item_id bigint, text string")
    for limit in (decontaminate.BLOCK_BYTES, 16):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", limit)
        got = sorted((r["doc_id"], r["item_id"], r["covered_words"]) for r in decontaminate.contaminated(spark, docs, items).collect())
        assert got == [(1, 10, 12), (1, 10, 12), (2, 10, 12), (3, 10, 12)]
    left = decontaminate.without_contaminated(spark, docs, items)
    assert left.columns == docs.columns and sorted(map(str, (r["doc_id"] for r in left.collect()))) == ["4", "5", "6", "None"]
    assert decontaminate.contaminated(spark, none(docs), items).count() == decontaminate.contaminated(spark, docs, none(items)).count() == 0


# 9: near copies


def shingles_of(text):
    w = words_of(text, fold=True)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components_by_hand(rows):
    sets = {i: shingles_of(t) for i, t in rows.items()}
    parent = {i: i for i in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(rows)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_copies_by_hand(spark, docs, texts):
    want = components_by_hand(texts)
    for r in near_dedup.near_duplicates(spark, docs).collect():
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_copies_of_a_dense_region(spark):
    """One original with many different near copies, most of them too far from each other."""
    rng = np.random.default_rng(2)
    base = [f"b{i}" for i in range(120)]
    rows = {500: " ".join(base)}
    for i in range(60):
        w = list(base)
        for k in range(2):
            w[int(rng.integers(0, 120))] = f"n{i}x{k}"
        rows[i] = " ".join(w)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark, spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")).collect()}
    assert got == {i: c for i, (_, c) in components_by_hand(rows).items()}


def test_a_template_just_too_different_meets_little(spark, monkeypatch):
    """600 documents of one template, each with a quarter of its words its own: no links, and no shared shingle brings all together."""
    base = [f"t{i}" for i in range(300)]
    rows = [(i, " ".join(w if k % 4 or k > 320 else f"own{i}x{k}" for k, w in enumerate(base + [f"z{i}y{j}" for j in range(20)]))) for i in range(600)]
    met = []
    whole = near_dedup._met
    monkeypatch.setattr(near_dedup, "_met", lambda index: met.append(whole(index).count()) or whole(index))
    got = near_dedup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert all(r["kept"] for r in got) and len(got) == 600
    text = lambda i: " ".join([f"s{k}" for k in range(300)] + [f"own{i}x{k}" for k in range(80)])
    rows = [(i, text(i)) for i in range(600)] + [(1000 + i, text(i) + " more") for i in range(3)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: i if i < 1000 else i - 1000 for i, _ in rows}
    assert all(n < 30 * 600 for n in met), met


def test_searches_by_rare_shingles_lose_no_link(spark):
    """Entries of random sets, dealt by classes of sizes: every similar pair meets at its first shared shingle."""
    rng = np.random.default_rng(47)
    sets = {}
    for i in range(120):
        if i % 3 and i > 3:
            base = list(sets[int(rng.integers(0, i))])
            drop = int(rng.integers(0, max(1, len(base) // 4)))
            sets[i] = set(rng.permutation(base)[drop:].tolist()) | set(rng.integers(0, 400, int(rng.integers(0, 4))).tolist())
        else:
            sets[i] = set(rng.integers(0, 400, int(rng.integers(4, 60))).tolist())
    df = Counter(x for s in sets.values() for x in s)
    rows = []
    for d, s in sets.items():
        for i, x in enumerate(sorted(s, key=lambda x: (df[x], x)), 1):
            if i <= len(s) - -(-75 * len(s) // 100) + 1:
                rows.append((d, len(s), x, i, d, True))
    got = {(r["id"], r["u"]) for r in near_dedup._met(spark.createDataFrame(rows, "id bigint, n bigint, shingle bigint, i bigint, at bigint, asks boolean")).collect()}
    want = {(a, b) for a in sets for b in sets if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert want <= got and len(want) > 150


def test_sketches_keep_pairs_at_the_limit():
    """Pairs of sets of a similarity of exactly 75 %: none of four hundred has a sketch below the floor."""
    rng = np.random.default_rng(53)
    shares = []
    for _ in range(400):
        x = rng.integers(0, 2**63, 160, dtype=np.uint64)
        a, b = (near_dedup._signature(s) & 0xFF for s in (x[:140], x[20:]))  # 120 of 160
        shares.append((a == b).mean())
    assert min(shares) >= near_dedup.SKETCH_FLOOR and abs(np.mean(shares) - 0.75) < 0.02


def test_near_copies_of_odd_rows(spark, odd):
    rows = near_dedup.near_duplicates(spark, odd).collect()
    assert len(rows) == odd.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["n_shingles"] == by_id[2]["n_shingles"] == by_id[3]["n_shingles"] == 0 and by_id[2]["component_id"] == 2
    assert by_id[4]["n_shingles"] == 1 and by_id[7]["component_id"] == 6 and not by_id[7]["kept"] and by_id[None]["kept"]
    assert near_dedup.near_duplicates(spark, none(odd)).count() == 0
    kept = near_dedup.keep_one_of_each(spark, odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)], "a bigint, b bigint")
    got = {r["id"]: r["component"] for r in components.connected_components(spark, edges, Scratch(spark, "test"), "x").collect()}
    assert got == dict.fromkeys(range(41), 0) | {90: 90, 95: 90, 100: 90}


# 10: shards


def test_shards_are_balanced_and_gapless(docs, texts):
    rows = sharding.shard_digest(docs, 8).collect()
    total = sum(r["size"] for r in rows)
    longest = max(r["size"] for r in rows)
    by_shard = defaultdict(list)
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
        by_shard[r["shard"]].append(r)
    assert sorted(by_shard) == list(range(8))
    for part in by_shard.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
        assert abs(sum(r["size"] for r in part) - total / 8) <= longest + total / 8 / 64


def test_a_group_with_a_third_of_all_rows_is_cut(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the one text").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    sizes = [r["n"] for r in sharding.shard_digest(rows, 8).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1.02 * min(sizes)


def test_shards_by_hand(spark, docs):
    """The same assignment from one sorted list; texts that fit 1/WHOLE_PART of a shard are whole."""
    few = docs.where("doc_id < 5").crossJoin(spark.range(40)).select((10**7 + F.col("doc_id") * 1000 + F.col("id")).alias("doc_id"), "text")
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 1300).cast("string")).alias("text"))
    empty = spark.range(3000).select((F.col("id") + 10**6).alias("doc_id"), F.lit("").alias("text"))
    for df in (docs.select("doc_id", "text"), few.unionByName(many).unionByName(empty)):
        rows = [(r["doc_id"], r["h"], r["size"], r["crc"]) for r in df.select("doc_id", F.xxhash64("text").alias("h"), sharding.text_bytes().alias("size"), F.crc32("text").alias("crc")).collect()]
        n, z, part = len(rows), sum(r[2] for r in rows), 8 * sharding.WHOLE_PART
        count, total = Counter(r[1] for r in rows), Counter()
        for _, h, size, _ in rows:
            total[h] += size
        heavy = {h for h in count if count[h] * part > n or total[h] * part > z}
        whole = {h for h in count if total[h] * part <= z}
        got = {r["doc_id"]: r for r in sharding.shard_digest(df, 8).collect()}
        place = lambda h: ((h & (2**64 - 1)) >> (64 - sharding.range_bits(n)), h if h in heavy else 0, h)
        before, want = 0, defaultdict(set)
        for h in sorted(count, key=place):
            middle = (2 * before + total[h]) * 8 // (2 * z)
            inside = {got[i]["shard"] for i, own, _, _ in rows if own == h}
            if h in whole or h not in heavy:
                assert inside == {min(7, middle)}
            else:
                assert inside <= set(range(min(7, before * 8 // z), min(7, (before + total[h]) * 8 // z) + 1))
            before += total[h]
        assert {r["doc_id"] for r in got.values()} == {r[0] for r in rows}
        sizes = Counter()
        for r in got.values():
            want[r["shard"]].add(r["slot"])
            sizes[r["shard"]] += r["size"]
        assert all(slots == set(range(len(slots))) for slots in want.values()) and sum(map(len, want.values())) == n
        assert all(abs(sizes[k] - z / 8) <= max(z / part, max(r[2] for r in rows)) for k in range(8))


def test_shards_of_odd_rows(odd):
    rows = sharding.shard_digest(odd, 8).collect()
    assert len(rows) == odd.count() and next(r for r in rows if r["doc_id"] == 1)["size"] == 1
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows) and sharding.shard_digest(none(odd), 8).count() == 0


def test_stages_with_clashing_names(spark, odd):
    """Columns named like the steps' own, and names with dots, through every stage of the pipeline."""
    import corpus_pipeline

    names = ("__size", "__shard", "__slot", "__draws", "row", "h", "id", "at", "a.b", "x`y", "own", "salt", "bucket", "n", "z")
    docs = odd.select("*", *(F.lit(f"is {n}").alias(n) for n in names if n not in odd.columns), F.lit(2).alias("__taken"))
    for _, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        rows = got.collect()
        assert 0 < len(rows) <= 3 * docs.count() and {"a.b", "x`y", "doc_id", "text", "source"} <= set(got.columns)
        assert all(r["a.b"] == "is a.b" and r["own"] == "is own" and r["row"] == "is row" for r in rows)
        assert len({c.lower() for c in got.columns}) == len(got.columns) and stage(spark, none(docs), SF).count() == 0
    assert {c.lower() for c in got.columns} >= {"size", "shard", "slot"}


# words and the pipeline


def test_words_equal_python():
    import pyarrow as pa

    texts = ["", None, "a B\tc", "  é ü\x0bx  ", "one", "a b c d e f", "\x85 nbsp\xa0word"]
    for first, _, raw, offsets in textkit.slices(pa.array(texts), limit=4):
        w = textkit.Words(raw, offsets)
        for d in range(len(offsets) - 1):
            span = slice(w.bounds[d], w.bounds[d + 1])
            found = [bytes(w.data[offsets[0] + a : offsets[0] + b]) for a, b in zip(w.start[span], w.end[span], strict=True)]
            assert found == words_of(texts[first + d], fold=True)


def test_pipeline_by_hand(spark, texts):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "decontaminate", "mix", "shard"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = corpus_pipeline.known_language(spark, docs, SF)
    assert known.columns == docs.columns and known.count() == docs.count()
    kept = {r["doc_id"] for r in corpus_pipeline.one_of_each(spark, known, SF).collect()}
    assert kept == {i for i, (_, c) in components_by_hand(texts).items() if c == i}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in rows} <= kept and not any(item in r["text"] for r in rows for item in items)
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows))) for s in range(8))


def test_broken_markup_keeps_text():
    """A quote opens a value only after "=" and where it closes; an empty svg hides nothing after it."""
    article = "<article>{}</article>".format
    assert html_text.extract(article('<p title=5">one "two" three</p>'), {}) == 'one "two" three'
    assert html_text.extract(article("<p data-x=it's>one</p><p>it's two</p>"), {}) == "one\nit's two"
    assert html_text.extract('<p class="a>one two</p><p>three</p>', {}) == "one two\nthree"
    assert html_text.extract('<p>one</p><svg viewBox="0 0 1 1"/><p>two</p><svg><path/></svg><p>three</p>', {}) == "one\ntwo\nthree"


@pytest.mark.parametrize("piece", ['<a x="', "<b ", "<p a='", "<!", "<div>", "<b>x ", "<div></p>"])
def test_long_broken_markup_is_read_once(piece):
    """Time grows with the page: 80,000 pieces would take minutes if each were scanned to the end."""
    began = time.perf_counter()
    html_text.extract(piece * 80_000, {})
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize(
    "page",
    [
        "<div class='content has-sidebar'><p>one two</p></div>",
        "<div class='layout with-nav no-footer'><article><p>one two</p></article></div>",
        "<div id='page-with-comments'><p>one two</p></div>",
        "<div class='sidebar-layout'><article><p>one two</p></article></div>",
        "<div class='banner'><div><main><p>one two</p></main></div></div>",
        "<div class='promo'><article><p>one two</p></article></div>",
        "<p title='the hidden cost'>one two</p>",
        "<p><a href='/hidden-valley/x'>one two</a> </p><p data-x=\"id='nav'\"></p>",
    ],
)
def test_content_is_not_hidden_by_its_wrapper(page):
    assert html_text.extract(page, {"w:a": 1.0}) == "one two"


@pytest.mark.parametrize("open_", ['<div class="layout has-sidebar">', '<div id="page" class="no-header">', '<div class="entry-content share-enabled">', '<div class="theme-default header-fixed">', '<section class="legal-article">'])
def test_ordinary_wrappers_keep_their_text(open_):
    """A menu, a comment list and the wrapper's own class names round a paragraph of eighty words."""
    words = " ".join(f"word{i}" for i in range(80))
    page = f"<body><nav><a href=/>home</a></nav>{open_}<p>{words}</p></{open_[1:].split()[0]}><div class='comment-list'><p>no, no and no</p></div><div class='site-footer'>no</div></body>"
    assert html_text.extract(page, {}) == words


@pytest.mark.parametrize("inner", ['<div class="ad-x">', '<div class="ad-x"><p>', '<section class="social-y">'])
def test_deep_hidden_parts_are_read_once(inner):
    """20,000 nested parts that names hide, with words and links in each."""
    began = time.perf_counter()
    html_text.extract(inner * 20_000 + "w </a>x" * 20_000, {})
    assert time.perf_counter() - began < 6


PARA = " ".join(f"word{i}" for i in range(45)) + "."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div class='cookie-recipe'><p>{PARA}</p></div><div class='social-science'><p>{PARA}</p></div>", f"{PARA}\n{PARA}"),
        (f"<div class='main-content related'><p>{PARA}</p></div>", PARA),
        (f"<article><p>{PARA}</p><div class='related-work'><p>{PARA}</p><p>{PARA}</p></div><p>{PARA}</p></article>", "\n".join([PARA] * 4)),
        (f"<article><p>{PARA}</p><p class='share-price'>The share price rose.</p><p>{PARA}</p></article>", f"{PARA}\nThe share price rose.\n{PARA}"),
        (f"<main><p>{PARA}</p><div class='usercomments'><p>{PARA}</p></div></main>", PARA),
        (f"<main><p>{PARA}</p><div class='user-comments'><p>{PARA}</p></div></main>", PARA),
        (f"<main><p>{PARA}</p><div class='community-comments'><p>{PARA}</p></div></main>", PARA),
        (f"<main><header><h1>Title of it</h1></header><p>{PARA}</p></main>", f"Title of it\n{PARA}"),
        (f"<article><p>{PARA}</p><div class='promo-teaser'><p>Buy this now</p></div><p>{PARA}</p></article>", f"{PARA}\n{PARA}"),
        (f"<article><p>{PARA} {PARA}</p></article><div class='related-teasers'><p>{PARA}</p><p>{PARA}</p></div>", f"{PARA} {PARA}"),
        (f"<p>{PARA}</p><div class='related-teasers'>" + "<li><a href=/>one more link of it</a></li>" * 30 + "</div>", PARA),
        (f"<body><p>{PARA}</p><div class='sitefooter'>{PARA}</div><div class='topbar-x'>no</div></body>", PARA),
    ],
)
def test_parts_of_mixed_names(page, text):
    assert html_text.extract(page, {}) == text


def test_titles_and_references():
    """An article's own header has its title; a reference is decoded in its own token alone."""
    assert html_text.extract("<header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>one two three four</p></article>", {}) == "Title\none two three four"
    assert html_text.extract("<p>one &<b>amp;</b> &lt;two&gt; &eacute;t&#233;</p>", {}) == "one &amp; <two> été"


def test_pages_of_any_length_teach(spark):
    """The only labelled page has over 200,000 characters and more than a thousand tag names."""
    page = "<article>" + "".join(f"<x{i}>" + "word " * 40 + f"</x{i}>" for i in range(1200)) + "</article><q>out</q>"
    weights = html_text.learn_weights(spark.createDataFrame([(page,)], "html string"))
    assert len(page) > 200_000 and len([k for k in weights if k.startswith("x")]) == 1200


def test_parts_stay_hidden():
    article = "<article><p>one two three</p></article>{}".format
    for part in ("<div class='comments'><article>no</article></div>", "<div class='related-posts'><article>no</article></div>", "<p hidden>no</p>", "<div class='site-header'>no</div>", "<p id=nav>no</p>", "<p style='DISPLAY: none'>no</p>"):
        assert html_text.extract(article(part), {}) == "one two three"
    assert html_text.extract("<div hidden class=banner><main>no</main></div>", {}) == ""
    assert html_text.extract("<p>one two three</p><div class='comments'><article>no</article></div>", {}) == "one two three"


def test_every_lexicon_term_is_found_misspelled(spark):
    """Rare terms, terms that a stem covers, and all of more than a hundred; and words with punctuation between them."""
    letters = "bcdfghklmnprstvwz"
    many = [f"{a}o{b}u{c}ax" for a in letters[:6] for b in letters[6:11] for c in letters[11:16]]
    stemmed = [f"grumb{x}" for x in ("ling", "lers", "ledon", "lique", "latus")]
    rows = [(1, f"{w} plain words") for w in many + stemmed for _ in range(5)] + [(0, "plain words here")] * 1000
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "label int, text string"))
    assert any("grumbling".startswith(s) for s in lexicon.stems)
    for term in [*many, *stemmed]:
        assert lexicon.look_up(term[:1] + "j" + term[2:]) is not None, term
    for text in ("idiot,you", "you/idiot", "such idiot...moron"):
        assert lexicon.features(text)[1] > 0
