"""What the learnt operators are measured by: personal data in changed formats, neutral mentions of groups."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from terraloom.llm import pii, toxicity

SF = "/root/testdata/sf0.01"


def changed(r, kind, value):
    """A base match in another format that people use, or None."""
    digits = re.sub("[^0-9]", "", value)
    if kind == "email":
        at, dot = r.choice([(" [at] ", " [dot] "), ("(at)", "(dot)"), ("{at}", "."), ("[at]", "[dot]")])
        return value.replace("@", at).replace(".", dot)
    if kind == "ip":
        return value.replace(".", r.choice(["[.]", " . ", "(.)"]))
    if kind == "card":
        return r.choice([".", "/", "_", " - "]).join(digits[k : k + 4] for k in (0, 4, 8, 12)) if len(digits) == 16 else None
    a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
    return r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"0043 {a} {b}{c}", f"({a}) {b} {c}"])


def test_personal_data_in_changed_formats(spark):
    r, rows, truth = random.Random(1), [], []
    for x in pii.detect(spark.read.parquet(f"{SF}/documents.parquet")).where("size(base) > 0").collect():
        out, at, own = "", 0, []
        for s in x.base:
            if s.start >= at and (new := changed(r, s.kind, x.source[s.start : s.end])):
                out += x.source[at : s.start]
                own.append((s.kind, len(out), len(out) + len(new)))
                out, at = out + new, s.end
        rows.append((len(truth), out + x.source[at:]))
        truth.append(own)
    total, found, added, right = Counter(), Counter(), Counter(), Counter()
    for x in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        new = {(s.kind, s.start, s.end) for s in x.spans} - {(s.kind, s.start, s.end) for s in x.base}
        meets = lambda a, b: a[1] < b[2] and b[1] < a[2]
        for t in truth[x.doc_id]:
            total[t[0]] += 1
            found[t[0]] += any(s.kind == t[0] and meets(t, (s.kind, s.start, s.end)) for s in x.spans)
        for s in new:
            added[s[0]] += 1
            right[s[0]] += any(meets(t, s) for t in truth[x.doc_id])
    assert set(total) == set(pii.KINDS)
    assert all(found[k] >= 0.9 * total[k] and right[k] >= 0.9 * added[k] for k in pii.KINDS), (total, found, added, right)


def test_penalty_removes_a_spurious_link_to_a_group(spark):
    """Half the toxic training texts name a group; without the penalty any mention of it then counts as toxic."""
    labels = {}
    for x in spark.read.parquet(f"{SF}/labels.parquet").where("toxic IS NOT NULL").collect():
        labels[x.doc_id] = x.toxic
    rows = sorted((x.doc_id, toxicity.words_of(x.text), labels[x.doc_id]) for x in spark.read.parquet(f"{SF}/documents.parquet").collect() if x.doc_id in labels)
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    group, columns = {"muslims"}, toxicity.Columns()
    train = [(w | group if y and k % 2 else w, y) for k, (d, w, y) in enumerate(rows) if not held(d)]
    twins = [toxicity.swapped(w) for w, _ in train]
    neutral = [w | group for d, w, y in rows if held(d) and not y]

    def false_positives(strength):
        w = toxicity.fit([columns.of(x) for x, _ in train], np.array([y for _, y in train], float), [None if t is None else columns.of(t) for t in twins], counterfactual=strength)
        return np.mean([w[columns.of(x)].sum() + w[-1] >= 0 for x in neutral])

    assert false_positives(0.0) > 0.3 and false_positives(1.0) < 0.1
