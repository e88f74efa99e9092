"""Licenses in lines and in wrapped paragraphs of one text."""

from threadloom.llm import licenses


def test_licenses_of_both_readings(spark):
    s = licenses.SENTENCES
    wrapped = "\n\n" + s["apache-the"].replace("Apache License, ", "Apache\nLicense, ") + ";\n" + s["apache-may-not"].replace("file except", "file\nexcept") + ".\n"
    rows = [
        (1, "SPDX-License-Identifier: MIT\nint x" + wrapped, "spdx id-mit apache-the apache-may-not"), (2, "MIT License\nCopyright Jo" + wrapped, "mit-short-title apache-the apache-may-not"),
        (3, "MIT License\nx\n\nAll rights reserved\ny\n\nReleased under the MIT License\nz" + wrapped, "mit-short-title reserved mit-released apache-the apache-may-not"),
        (4, s["gpl-published"] + ",\n" + s["gpl2-either"], "gpl-published gpl2-either"), (5, 'Licensed under the Apache License, Version 2.0\n(the "License")', "apache-the"), (6, "\x01\n\n \nMIT\n", "id-mit"),
    ]
    got = licenses.licensed(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()
    assert [" ".join(r["ids"]) for r in got] == [r[2] for r in rows]
    assert [r["licenses"] for r in got[:3]] == [["Apache-2.0", "MIT"]] * 3
    assert [r["n_sentences"] for r in got] == [7, 6, 10, 2, 2, 1]
