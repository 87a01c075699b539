"""The pipeline's stages, by value, against plain Python on a small table."""

import re

import pytest

import corpus_pipeline
from lodestone.llm import editing, lines, nearcopies, quality
from test_small import distance, docs, like, prose

BENCH = prose(500, 40)


def rows():
    out = [(i, prose(i, 80)) for i in range(12)]
    out += [(20, prose(0, 80)), (21, " ".join(w if k % 25 else f"other{k}." for k, w in enumerate(prose(1, 80).split(), 1)))]  # copies of 0 and 1
    out += [(30, prose(30, 60) + "\n" + prose(2, 80)), (31, prose(31, 60) + "\n" + prose(700, 20)), (32, prose(32, 60) + "\n" + prose(700, 20) + "\nHome | About | Contact")]
    out += [(40, prose(40, 30) + " " + BENCH), (50, "too few words"), (51, None), (52, ("same five words again here " * 9).strip() + "."), (60, "\n".join(f"this has no end {k}" for k in range(20)))]
    return out


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def cleaned(t):
    """Quality: lines that fail are cut; then too few words, repeats, or too much lost."""
    w = words(t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    again = len({i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)})
    bad = [x for x in (t or "").split("\n") if words(x) and ((len(words(x)) >= 4 and x[-1] not in quality.MARKS) or x.count("|") >= 2)]
    lost = sum(len(y) for x in bad for y in words(x))
    if len(w) < 10 or 100 * again > 20 * len(w) or 100 * lost > 40 * sum(map(len, w)):
        return None
    return "\n".join(x for x in (t or "").split("\n") if x not in bad)


def alike(a, b):
    x, y = words(a.lower()), words(b.lower())
    return 1 - distance(x, y) / max(len(x), len(y), 1) >= nearcopies.SIMILARITY - 1e-9


def without_repeats(table):
    """Lines: of like lines the first stays, but near-copies of whole texts are left to the next stage."""
    seen, out = [], []
    for i, t in table:
        keep = []
        for x in t.split("\n"):
            first = next(((j, y, full) for j, y, full in seen if len(x) >= lines.LEAST_CHARS and (x == y or like(x, y))), None)
            if first is None or (first[0] != i and alike(t, first[2])):
                keep.append(x)
            if first is None:
                seen.append((i, x, t))
        out.append((i, "\n".join(keep)))
    return out


def test_stages_by_value(spark, tmp_path):
    table = rows()
    spark.createDataFrame([(7, BENCH), (8, prose(900, 40))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame, want = docs(spark, table), [(i, t) for i, t in table]
    stages = dict(corpus_pipeline.STAGES)
    got = {}
    for name in ("quality_rules", "line_dedup", "near_dedup", "decontamination"):
        frame = stages[name](spark, frame, str(tmp_path))
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        held = frame.collect()
        got[name] = {r.doc_id: r.text for r in held}
        assert len(held) == len(got[name]) and all(r.n_chars == len(r.text) for r in held)
        frame = spark.createDataFrame(held, frame.schema)
        if name == "quality_rules":
            want = [(i, c) for i, t in want if (c := cleaned(t)) is not None]
        elif name == "line_dedup":
            want = without_repeats(want)
        elif name == "near_dedup":
            kept = []
            for i, t in want:
                if not any(alike(t, u) for _, u in kept):
                    kept.append((i, t))
            want = kept
        else:
            want = [(i, t) for i, t in want if BENCH not in t]
        assert got[name] == dict(want), name
    assert set(got["quality_rules"]) == {*range(12), 20, 21, 30, 31, 32, 40}
    assert got["quality_rules"][32] == prose(32, 60) + "\n" + prose(700, 20)
    assert got["line_dedup"][30] == prose(30, 60) and got["line_dedup"][32] == prose(32, 60) and got["line_dedup"][20] == prose(0, 80)
    assert set(got["near_dedup"]) == {*range(12), 30, 31, 32, 40} and 40 not in got["decontamination"]
    from test_small import shards

    pytest.importorskip("public_tokenizers")
    import pyarrow as pa

    from lodestone.llm.queries import tokenizer

    out = stages["best_fit_packing"](spark, frame, str(tmp_path)).collect()
    sizes = shards.Encoder(tokenizer(), 2).sizes(pa.array([r.text for r in held]))
    assert {r.doc_id: r.n_tokens for r in out} == dict(zip([r.doc_id for r in held], sizes.tolist()))
    assert editing.edit_distance("abc", "abd", 1) == 1
