"""No license is lost: every rule fires on its own published text, wrapped or not, whatever stands around it."""

import duckdb
import pytest

from threadloom.llm import licenses


def scan(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = licenses.report(licenses.licensed(df)).orderBy("doc_id").toPandas()
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = con.execute(licenses.oracle_sql()).df().sort_values("doc_id")
    assert got.to_dict("records") == want[got.columns].to_dict("records")
    return got


def ends(rule):
    """A rule's sentences as they are published: after a tag a colon, after others a full stop."""
    return [licenses.SENTENCES[i] + (":" if i == "spdx" else ".") for i in rule]


def wrapped(text, width):
    lines, line = [], ""
    for word in text.split(" "):
        if line and len(line) + len(word) > width:
            lines.append(line)
            line = ""
        line = f"{line} {word}".strip()
    return "\n".join([*lines, line])


@pytest.mark.parametrize("width", [30, 60, 10_000])
def test_every_rule_fires_on_its_own_text(spark, width):
    texts = [wrapped(" ".join(ends(rule)), width) for _, rule in licenses.RULES]
    got = scan(spark, texts)
    assert got["licenses"].tolist() == [name for name, _ in licenses.RULES]
    assert got["ids"].tolist() == [" ".join(rule) for _, rule in licenses.RULES] and not got["n_left"].any()


HEADERS = [
    ("x y z\nThis work is licensed under the GNU General\nPublic License, version 3\nMIT License\nfoo", "GPL-3.0-only,MIT"),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.", "MPL-2.0"),
    ("This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.", "LGPL-2.1-or-later"),
    ("This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License version 2 as\npublished by the Free Software Foundation.", "GPL-2.0-only"),
    ("// SPDX-License-Identifier: MIT OR Apache-2.0\nint main;", "Apache-2.0,MIT"), ("SPDX-License-Identifier: (MPL-2.0 AND BSD-3-Clause)", "BSD-3-Clause,MPL-2.0"), ("SPDX-License-Identifier: MPL-2.0", "MPL-2.0"),
    ("one\ntwo\nReleased under\nthe MIT\nLicense\nthree", "MIT"), ("Released\nunder\nthe\nMIT\nLicense", "MIT"), ("the\nthe mit\nthe MIT License (MIT)\nthe", "MIT"), ("not MIT License", ""), ("MIT License here", ""), ("v. 2 or more", ""),
    (None, ""), ("", ""), ("MIT License\n" * 300, "MIT"),
]


def test_real_headers_and_odd_lines(spark):
    got = scan(spark, [t for t, _ in HEADERS])
    assert got["licenses"].tolist() == [names for _, names in HEADERS]


def test_long_texts_without_stops(spark):
    text = "\n".join(["you may not", "the software", "this"] * 20_000)
    assert licenses.licensed(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["licenses"] == []
