import re
from collections import Counter, defaultdict

import pytest
from fixtures import awkward, empty

from terrapart.llm.quality_rules import RESULTS, passed, quality_rules


def brute(rows, max_docs, percent, left):
    """rows: (key, text, source); what quality_rules must say of each distinct row."""
    holders, hosts = defaultdict(set), defaultdict(set)
    for key, text, source in rows:
        document = ("text", text or "") if key is None else key
        hosts[source].add(document)
        for line in (text or "").split("\n"):
            if k := " ".join(re.findall(r"[^\x20\x09-\x0D]+", line)).lower():
                holders[source, k].add(document)
    out = {}
    for key, text, source in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        count = Counter(grams)
        covered = {p for i, g in enumerate(grams) if count[g] > 1 for p in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        kept_lines, gone, n_gone = [], 0, 0
        for line in t.split("\n"):
            k = " ".join(re.findall(r"[^\x20\x09-\x0D]+", line)).lower()
            n = len(holders[source, k]) if k else 0
            if n > max_docs and n * 100 > len(hosts[source]) * percent:
                gone, n_gone = gone + len(k.split(" ")), n_gone + 1
            else:
                kept_lines.append(line)
        kept = not failed and (len(w) - gone) * 100 >= len(w) * left
        clean = text if text is None else "\n".join(kept_lines)
        out[key] = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed, gone, n_gone, kept, clean)
    return out


@pytest.mark.parametrize("limits", [(20, 2.0, 30.0), (0, 1.0, 60.0), (1, 20.0, 30.0)])
def test_against_plain_python(spark, limits):
    docs = awkward(spark)
    got = quality_rules(docs, *limits).collect()
    want = brute([((r.doc_id, r.text, r.source), r.text, r.source) for r in docs.collect()], *limits)
    assert len(got) == docs.count()
    for r in got:
        own = want[r.doc_id, r.text, r.source]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "n_removed_lines", "kept", "clean_text")) == own, r.doc_id
    assert passed(quality_rules(docs, *limits)).count() == sum(r.kept for r in got)


def test_empty(spark):
    found = quality_rules(empty(spark))
    assert found.count() == 0 and set(RESULTS) <= set(found.columns)
