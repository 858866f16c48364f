import duckdb
import pandas as pd

from concord.llm.licences import RULES, SENTENCES, scan, scan_sql

MIT = """Copyright (c) 2020-2021 Some Holder

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
ROWS = [
    (1, MIT),
    (2, "prose without end\nReleased under the MIT License."),
    (3, "Some prose. Licensed under CC BY-NC 4.0. More prose."),
    (4, "| a | b |\nThis work is licensed under the GNU General Public License, version 3.\nLicensed under the Apache License, Version 2.0."),
    (5, "The license of this is unclear; all rights of others stay."),
    (6, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\nRedistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    (7, "Copyright 2001 by somebody. All rights reserved."),
    (8, "licensed under CC0 1.0. LICENSED UNDER CC0 1.0."),
]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_rules_match_sequences(docs):
    found = {r.doc_id: (r.licences, r.n_known, r.n_unmatched) for r in scan(docs(ROWS)).collect()}
    assert found[1] == ("MIT", 5, 0)
    assert found[2] == ("MIT", 1, 0) and found[3] == ("CC-BY-NC-4.0", 1, 0)
    assert found[4] == ("Apache-2.0,GPL-3.0-only", 2, 0) and found[5] == ("", 0, 0)
    assert found[6] == ("", 2, 2)  # two sentences of a rule, but not in a row
    assert found[7][0] == "" and found[7][2] == 0 and found[8] == ("CC0-1.0", 2, 0)


def test_same_as_sql(docs, hard):
    documents = pd.DataFrame([(i, t) for i, t in ROWS + hard], columns=["doc_id", "text"]).astype({"doc_id": "Int64"})  # noqa: F841
    want = sorted(duckdb.sql(scan_sql()).fetchall(), key=str)
    rows = scan(docs(ROWS + hard)).select("doc_id", "n_known", "sentences", "licences", "n_unmatched")
    assert got(rows) == want


def test_empty_table(docs):
    assert got(scan(docs([]))) == []


def test_every_rule_is_of_known_sentences():
    assert all(x in SENTENCES for _, ids in RULES for x in ids)
    assert len(set(SENTENCES.values())) == len(SENTENCES)
