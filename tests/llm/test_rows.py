"""Operators that judge rows one by one: quality rules, licences, language, BPE."""

import random
from collections import Counter

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, language, licences, oracle, quality, queries

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def sql_rows(rows, sql):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    return sorted(con.execute(sql).fetchall(), key=repr)


def test_quality_equals_sql_on_odd_rows(frame, odd_rows):
    rows = odd_rows + [(9, "a b c a b c\na b c\n\na b c"), (10, "x x x x x"), (11, "#a $b | c\n#a $b | c")]
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = quality.judge(frame(rows)).select(names).collect()
    assert sorted(map(tuple, got), key=repr) == sql_rows(rows, oracle.quality())


def test_repeated_words_by_brute_force(frame):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 30)))) for i in range(200)]
    got = {r.doc_id: r.n_repeat_words for r in quality.judge(frame(rows)).collect()}
    for i, text in rows:
        words = text.split()
        grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        seen = Counter(grams)
        held = {k + d for k, g in enumerate(grams) if seen[g] > 1 for d in range(3)}
        assert got[i] == len(held)


def test_quality_is_one_projection_and_filter(frame):
    df = quality.judge(frame([(1, "x")])).where("kept")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("RoundRobin", "").split("Project")[0]
    assert "Python" not in plan and "Arrow" not in plan


def test_clashing_columns(frame):
    df = frame([(1, "x y")]).withColumn("kept", F.lit("mine")).withColumn("n_words", F.lit("mine"))
    row = quality.judge(df).collect()[0]
    assert row.kept is False and row.n_words == 2 and row.source == "s"
    df = frame([(1, "Released under the MIT License.")]).withColumn("licences", F.lit(1))
    assert licences.scan(df).collect()[0].licences == "MIT"


def test_empty_tables(frame, spark):
    empty = frame([(1, "x")]).limit(0)
    codec = bpe.Codec(spark, TOKENIZER)
    assert quality.judge(empty).count() == licences.scan(empty).count() == 0
    assert language.predict(empty, {}).count() == codec.encode(empty).count() == 0


def test_licences_equal_sql(frame, odd_rows):
    rows = odd_rows + [
        (20, "Copyright 2020. All Rights Reserved"),
        (21, "Released under the MIT Licence! Licensed under CC BY 4.0."),
        (22, "x\nYou may not use this file except in compliance with the License.\nYou may obtain a copy of\nthe License at"),
        (23, "This is  FREE and unencumbered software\nreleased into the public domain. All rights reserved."),
        (24, "The MIT License is nice"),
    ]
    got = licences.scan(frame(rows)).select("doc_id", "sentences", "licences").collect()
    assert sorted(map(tuple, got), key=repr) == sql_rows(rows, oracle.licences())
    found = {r.doc_id: r.licences for r in got}
    assert found[22] == "Apache-2.0" and found[23] == "Unlicense" and found[24] == ""
    assert found[20] == "LicenseRef-all-rights-reserved" and found[21] == "MIT,CC-BY-4.0"


GPL = (
    "This program is free software{} you can redistribute it and/or modify\nit under the terms of the GNU General "
    "Public License as published by\nthe Free Software Foundation{} either version {} of the License, or\n(at your "
    "option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY "
    "WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\n"
    "GNU General Public License for more details.\n"
)
MPL = (
    "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL "
    "was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */\n"
)


def found_licences(frame, texts):
    rows = licences.scan(frame(list(enumerate(texts)))).collect()
    return [r.licences for r in sorted(rows, key=lambda r: r.doc_id)]


def test_known_sentences_with_marks_inside(frame):
    """Notices in their official punctuation, wrapped and on one line."""
    texts = {f"# SPDX-License-Identifier: {licence}\n\nimport os\n": licence for licence in licences.NAMES}
    texts |= {GPL.format(":", ",", 3): "GPL-3.0", GPL.format(";", ";", 2): "GPL-2.0", MPL: "MPL-2.0"}
    texts |= {t.replace("\n", " "): name for t, name in texts.items() if "SPDX" not in t}
    texts |= {"SPDX-License-Identifier: Other. MIT. ": "", "SPDX-License-Identifier:": ""}
    assert found_licences(frame, texts) == list(texts.values())


MIT = (
    "MIT License\n\nCopyright (c) 2020 Jo Doe\n\nPermission is hereby granted, free of charge, to any person obtaining "
    "a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without "
    "restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, "
    "sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do "
    "so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be "
    "included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\".\n"
)
ISC = (
    "ISC License\n\nCopyright (c) 2020, Jo Doe\n{}Permission to use, copy, modify, and/or distribute this software for "
    "any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission "
    "notice appear in all copies.\n"
)
BSD2 = (
    "Copyright (c) 2020, Jo Doe\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or "
    "without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source "
    "code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. "
    "Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the "
    "following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n\n"
)
BSD3 = BSD2 + (
    "3. Neither the name of {} nor the names of its\n   contributors may be used to endorse or promote products derived "
    "from\n   this software without specific prior written permission.\n\n"
)
EPL = (
    "/*\n * Copyright (c) 2020 Jo Doe\n *\n * This program and the accompanying materials are made\n * available under the "
    "terms of the Eclipse Public License 2.0\n * which is available at https://www.eclipse.org/legal/epl-2.0/\n *\n */\n"
)


def test_standard_licence_files(frame):
    lesser = GPL.replace("GNU General", "GNU Lesser General")
    library = lesser.replace("This program", "This library")
    texts = {
        MIT: "MIT", MIT.replace("\n", "\r\n"): "MIT", ISC.format("\n"): "ISC", ISC.format(""): "ISC",
        BSD2: "BSD-2-Clause", BSD3.format("the copyright holder"): "BSD-3-Clause",
        BSD3.format("Google Inc."): "BSD-3-Clause", BSD3.format("Jo's Project"): "BSD-3-Clause",
        BSD3.format("the copyright holder") + BSD2: "BSD-3-Clause,BSD-2-Clause",
        BSD2 + BSD3.format("the copyright holder"): "BSD-3-Clause,BSD-2-Clause",
        library.format(";", ";", "2.1"): "LGPL-2.1", lesser.format(":", ",", "3"): "LGPL-3.0",
        GPL.replace("GNU General", "GNU Affero General").format(":", ",", "3"): "AGPL-3.0", EPL: "EPL-2.0",
    }
    assert found_licences(frame, texts) == list(texts.values())


APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance "
    "with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n"
    "Unless required by applicable law or agreed to in writing, software\ndistributed under the License.\n"
)


def test_apache_header_and_spdx_expressions(frame):
    texts = {
        APACHE: "Apache-2.0", APACHE.replace("\n", " "): "Apache-2.0", "# " + APACHE.replace("\n", "\n# "): "Apache-2.0",
        "SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0", "SPDX-License-Identifier: LGPL-2.1-only\n": "LGPL-2.1",
        "// SPDX-License-Identifier: MIT OR Apache-2.0\nint x;": "Apache-2.0,MIT",
        "SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0) AND BSD-3-Clause": "GPL-2.0,BSD-3-Clause",
        "SPDX-License-Identifier: Unknown-1.0 OR Other": "",
    }
    got = found_licences(frame, texts)
    assert [set(g.split(",")) for g in got] == [set(w.split(",")) for w in texts.values()]


def test_licence_sql_equals_the_query_on_licence_files(frame):
    lesser = GPL.replace("GNU General", "GNU Lesser General")
    texts = [MIT, ISC.format("\n"), ISC.format(""), BSD2, BSD3.format("Google Inc."), BSD3.format("the copyright holder") + BSD2,
             BSD2 + BSD3.format("Jo's Project"), BSD2 + BSD2, EPL, MPL, APACHE, lesser.format(":", ",", "3"),
             GPL.format(":", ",", 3), GPL.format(";", ";", 2), "SPDX-License-Identifier: MIT OR GPL-2.0-only\n\nx",
             "SPDX-License-Identifier:", "SPDX-License-Identifier: MIT. x"]
    rows = list(enumerate([*texts, *(t.replace("\n", " ") for t in texts), *(t.replace("\n", "\r\n") for t in texts)]))
    got = licences.scan(frame(rows)).select("doc_id", "sentences", "licences").collect()
    assert sorted(map(tuple, got), key=repr) == sql_rows(rows, oracle.licences())
    assert sum(r.licences != "" for r in got) > 40


def test_every_known_sentence_has_a_hint(spark):
    known = spark.createDataFrame([(s,) for s in licences.known_sentences()], "s string")
    assert known.where(~F.col("s").rlike(licences.hints())).isEmpty()


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = queries.QUERIES["op4_language"](spark, "/root/testdata/sf0.01")
    right = docs.join(found, "doc_id").where("held_out").select((F.col("lang") == F.col("lang_pred")).alias("ok"))
    share = right.agg(F.avg(F.col("ok").cast("int"))).first()[0]
    assert share > 0.98


def test_language_odd_rows(frame, odd_rows, spark):
    rows = odd_rows + [(30, "12 34 !?"), (31, "\U0001f600 日本")]
    docs = frame(rows, ["en"] * (len(rows) - 1) + ["ja"])
    found = {r.doc_id: r for r in language.predict(docs, language.learn(docs)).collect()}
    assert len(found) == len({i for i, _ in rows})
    assert {found[i].lang_pred for i in (2, 3, 4, 30)} == {"und"}
    assert found[31].lang_pred == "ja" and 0 <= found[6].score <= 1
    assert {r.lang_pred for r in language.predict(docs, {}).collect()} == {"und"}


def test_language_slices_change_nothing(monkeypatch):
    text = "Eine kleine Probe, 12 über mehrere Stücke hinweg. " * 5
    whole = [x.tolist() for x in language.sequences(text)]
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(language, "SLICE", size)
        assert [x.tolist() for x in language.sequences(text)] == whole


ALPHABET = [*"aB's't ré\n\t \r\x0b\x1c\x85\xa0ñß漢字9½…—!?#", "　", " ", "\U0001f600", "<|endoftext|>", "'ll", " ing"]


def test_bpe_equals_the_library(frame, spark, odd_rows):
    rng = random.Random(2)
    rows = [(i + 100, "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 20)))) for i in range(3000)]
    rows += odd_rows
    codec, library = bpe.Codec(spark, TOKENIZER), Tokenizer.from_file(TOKENIZER)
    for row in codec.decode(codec.encode(frame(rows))).collect():
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        assert row.ids == ids
        assert row.decoded == library.decode(ids, skip_special_tokens=False)
    both = Counter((r.doc_id, r.text, tuple(r.ids), r.decoded) for r in codec.round_trip(frame(rows)).collect())
    assert both == Counter((r.doc_id, r.text, tuple(r.ids), r.decoded) for r in codec.decode(codec.encode(frame(rows))).collect())

def test_bpe_pieces_seen_before_are_not_cut_again(monkeypatch):
    with open(TOKENIZER, encoding="utf-8") as file:
        runs = bpe.Runs(bpe.Vocabulary(file.read()))
    cut, seen = runs.vocabulary.cut, []
    monkeypatch.setattr(runs.vocabulary, "cut", lambda data: seen.append(data) or cut(data))
    assert runs[" heenly."] and runs[" heenly!!"] and runs[" heenly"]
    assert seen == [b" heenly", b".", b"!!"]
    rng = random.Random(6)
    for _ in range(2000):
        text = "".join(rng.choice("ab'stl9 \t\n\x1c\x00.%") for _ in range(rng.randint(0, 12)))
        assert bpe.ASCII_PRETOKENS.findall(text) == bpe.PRETOKENS.findall(text)


def test_bpe_slices_and_broken_utf8(frame, spark, monkeypatch):
    with open(TOKENIZER, encoding="utf-8") as file:
        runs = bpe.load(file.read())
    text = "It's a  test \n\n of   slices, über-long. " * 20
    whole = runs.text(text)
    monkeypatch.setattr(bpe, "SLICE", 7)
    assert runs.text(text) == whole
    codec, library = bpe.Codec(spark, TOKENIZER), Tokenizer.from_file(TOKENIZER)
    parts = [[170], [126, 170], [50256, 220], []]
    df = spark.createDataFrame([(p,) for p in parts], "ids array<int>")
    assert [r.decoded for r in codec.decode(df).collect()] == [library.decode(p, skip_special_tokens=False) for p in parts]


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n in oracle.ORACLE])
def test_query_equals_sql(spark, name):
    from oracle_check import same

    ok, detail = same(spark, "/root/testdata/sf0.001", name)
    assert ok, detail
