"""The manifest against a plain Merkle tree."""

import hashlib
import string
import zlib
from collections import Counter

import pytest

from tapeloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, i long, digest string, run string"


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(leaves, fan):
    """Root of a list of digests, and the (before, after) steps of each."""
    steps, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for k, place in enumerate(at):
            run = level[place - place % fan : place - place % fan + fan]
            steps[k].append(("".join(run[: place % fan]), "".join(run[place % fan + 1 :])))
            at[k] = place // fan
        level = [H("".join(level[i : i + fan])) for i in range(0, len(level), fan)]
    return level[0], steps


def brute(rows, fan=8):
    first = lambda v: (v is not None, v if v is not None else 0)
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (first(r[0]), leaf(*r))) for g in langs}
    climbed = {g: climb([leaf(*r) for r in trees[g]], fan) for g in langs}
    root, top = climb([climbed[g][0] for g in langs], fan)
    out = Counter()
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    for g, above in zip(langs, top, strict=True):
        for row, own in zip(trees[g], climbed[g][1], strict=True):
            steps = own + above
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[1] is not None
            held = leaf(row[0], row[1].translate(lower), *row[2:]) if tampered else leaf(*row)
            for before, after in steps:
                held = H(before + held + after)
            out[(row[0], leaf(*row), climbed[g][0], root, H("".join(a + b for a, b in steps)), held, held == root)] += 1
    return out


def found(spark, rows, **more):
    df = merkle.manifest(spark.createDataFrame([(*r, 7, "clash", None) for r in rows], SCHEMA), **more)
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return Counter(tuple(r) for r in df.collect())


CASES = [(None, "no id", "en", "a", 1), (None, "no id", "en", "a", 1), (None, "Other", "en", None, None), (3, None, None, "b", 0), (4, "", None, None, 0),
         (5, "Zwei Ä", "de", "c", 12), (5, "Zwei ä", "de", "c", 12), (5, "Zwei ä", "de", "c", 12), (-7, "x", "=", "-", -3), (8, "Alone", "", "d", 5), (9, "Alone", "-", "d", 5)]


@pytest.mark.parametrize("fan", [2, 8])
def test_manifest_with_nulls_repeats_and_clashes(spark, fan):
    rows = CASES + [(100 + i, f"Text {i} " * (i % 5), "fr" if i % 3 else "en", f"s{i % 4}", i) for i in range(75)]
    assert found(spark, rows, fan=fan) == brute(rows, fan)


def test_more_languages_than_a_run(spark):
    rows = [(i, f"Word {i}", f"l{i % 70}", "s", i) for i in range(150)]
    got = found(spark, rows)
    assert got == brute(rows)
    assert {k[6] for k in got} == {True, False}


def test_one_row_one_language_and_none(spark):
    assert found(spark, [(1, "lower case", "en", "s", 3)]) == brute([(1, "lower case", "en", "s", 3)])
    rows = [(i, "Long " * 60_000 if i == 2 else "B", "en", "s", 3) for i in range(9)]
    assert found(spark, rows) == brute(rows)
    empty = merkle.manifest(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and len(empty.columns) == 7
