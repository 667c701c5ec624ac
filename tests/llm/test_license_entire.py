"""Entire licences, alone and inside of documents."""

import random
import textwrap
from pathlib import Path

from ledgerloom.llm import license_scan

FILES = Path(license_scan.__file__).parent / "licenses"


def test_entire_licences(spark):
    read = lambda name: (FILES / f"{name}.txt").read_text()
    mit = read("MIT")
    comments = "int a;\n/*\n" + "\n".join(f" * {x}" for x in mit.split("\n")) + "\n */\nint b;"
    wrapped = "Preface.\n\n" + " ".join(mit.split()) + "\n\nThe end."
    docs = [("MIT License\n\nCopyright (c) 2020 A\n\n" + mit, "MIT", 1, "MIT"), (comments, None, 1, "MIT"), (wrapped, None, 1, "MIT"), (mit + mit, None, 2, "MIT"), (mit[:-30], None, 0, ""), ("un" + mit, None, 0, "")]
    docs += [(read(n), n, 1, n) for n in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0")]
    docs += [("Two:\n" + mit + "\nand\n" + read("BSD-3-Clause"), None, 2, "BSD-3-Clause,MIT")]
    frame = spark.createDataFrame([(i, d[0]) for i, d in enumerate(docs)], "doc_id long, text string")
    got = {r.doc_id: (r.text_license, r.n_notices, r.licenses) for r in license_scan.scan_licenses(spark, frame).collect()}
    assert got == {i: d[1:] for i, d in enumerate(docs)}


def test_notices_over_several_lines(spark):
    isc = license_scan.KNOWN["ISC"][0]
    wrapped = textwrap.fill(isc, 80)
    docs = [(wrapped, 1), ("int a;\n" + textwrap.indent(wrapped, " * ") + "\nint b;", 1), (f"{wrapped}\n\n{wrapped}", 2), ("So: " + wrapped, 0), (wrapped + " Or not.", 0), (isc[:-30], 0)]
    docs += [("Licensed under the Apache License,\nVersion 2.0.", 1), ("Not licensed under the Apache License,\nVersion 2.0.", 0), ("Licensed under the Apache License,\n\n-- \nVersion 2.0.\nMore.", 1), ("Licensed under\nCC BY 4.0.\nLicensed under CC BY 4.0.", 2)]
    frame = spark.createDataFrame([(i, d[0]) for i, d in enumerate(docs)], "doc_id long, text string")
    got = {r.doc_id: r.n_notices for r in license_scan.scan_licenses(spark, frame).collect()}
    assert got == {i: d[1] for i, d in enumerate(docs)}


def test_runs_against_every_run_of_lines(spark):
    """Short texts over few words, where known ones repeat, overlap and begin alike."""
    dice = random.Random(5)
    words = lambda n: " ".join(dice.choice("abc") for _ in range(n))
    known = {f"L{i}": [words(dice.randint(1, 12)), words(2)] for i in range(6)}
    texts = ["".join(dice.choice(["a", "b", "c"]) + dice.choice([" ", " ", "\n", "\n\n", ", "]) for _ in range(dice.randint(0, 60))) for _ in range(200)]
    plain = {t: min(k for k, v in known.items() if t in v) for v in known.values() for t in v}

    def brute(text):
        lines = [" ".join(x.replace(",", " ").split()) for x in text.split("\n")]
        lines = [x for x in lines if x]
        runs = [plain.get(" ".join(lines[i:j])) for i in range(len(lines)) for j in range(i + 1, len(lines) + 1)]
        found = [x for x in runs if x]
        return plain.get(" ".join(lines)), len(found), ",".join(sorted(set(found)))

    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.text_license, r.n_notices, r.licenses) for r in license_scan.scan_licenses(spark, frame, known).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    assert sum(x[1] for x in got.values()) > 200
