import random
import re

from stratavox.llm.unit_dedup import dedup_units


def brute(rows, least):
    cut = lambda text: re.sub(r"([.!?][ \t]+|\n)", "\\1\0", text or "").split("\0")
    first, out = {}, []
    for i, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        for nth, unit in enumerate(cut(text)):
            norm = b" ".join(unit.encode().lower().split())
            if norm.count(b" ") >= least - 1:
                first.setdefault(norm, (i, nth))
    for i, text in rows:
        kept, removed, start = [], [], 0
        for nth, unit in enumerate(cut(text)):
            norm = b" ".join(unit.encode().lower().split())
            if norm.count(b" ") >= least - 1 and first[norm] != (i, nth):
                removed.append((nth, start, len(unit), first[norm][0]))
            else:
                kept.append(unit)
            start += len(unit)
        out.append((i, len(cut(text)), "".join(kept), tuple(removed)))
    return out


def test_removed_lines_equal_brute_force(spark):
    draw = random.Random(2)
    lines = ["a b c d e f", "A  b c d\te F ", "short one", "", "ü é ñ ö ä x", "this line is repeated very often", "x y z u v", "Lead in. One whole sentence of a passage! Another one of the passage?  tail", "one whole sentence of a passage!"]
    rows = [(i, "\n".join(draw.choice(lines) if draw.random() < 0.5 else f"own line number {i} {k} is here" for k in range(draw.randint(0, 8)))) for i in range(80)]
    rows += [(500, None), (501, ""), (None, "a b c d e f\nonly in the row without id"), (7, rows[7][1])]
    got = dedup_units(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    found = [(r.doc_id, r.n_units, r.kept, tuple((x.nth, x.start, x.length, x.keep_id) for x in r.removed or [])) for r in got]
    order = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(found, key=order) == sorted(brute(rows, 5), key=order)


def test_empty_table(spark):
    assert dedup_units(spark.createDataFrame([], "doc_id long, text string")).collect() == []
