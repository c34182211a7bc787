"""License scans against plain Python."""

import random
import re

import pytest

from tidemark.llm import licenses, queries
from tidemark.llm.licenses import Template

LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(LOW).decode())


def by_hand(text, templates, k=5, percent=75):
    """(n_words, n_base, first_word, last_word, base_labels, labels, score), by looking at each diagonal of each template."""
    words, base, base_labels, labels, score = words_of(text), [], set(), set(), 0.0
    for t in templates:
        own = words_of(t.text)
        m = min(k, len(own))
        if not m:
            continue
        votes = {}
        places = {}
        for at in range(len(own) - m + 1):
            places.setdefault(tuple(own[at : at + m]), []).append(at)
        for p in range(len(words) - m + 1):
            for at in places.get(tuple(words[p : p + m]), ()):
                votes.setdefault(p - at, set()).update(range(at, at + m))
        spans, last = [], None
        for d in sorted(votes):
            if last is None or d - last > (0 if t.base else len(own) // 4):
                spans.append((set(), []))
            spans[-1][0].update(votes[d])
            spans[-1][1].append(d + min(votes[d]))
            last = d
        for covered, starts in spans:
            share = len(covered) / len(own)
            score = max(score, share)
            if t.base:
                base.append(min(starts))
                base_labels.add(t.label)
            if t.base or share * 100 >= percent:
                labels.add(t.label)
    return len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score


def rows_of(df):
    return sorted(((r.doc_id, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)) for r in df.collect()), key=repr)


def wanted(df, templates=licenses.DEFAULT, **more):
    return sorted(((r.doc_id, by_hand(r.text, templates, **more)) for r in df.select("doc_id", "text").collect()), key=repr)


def test_query(spark, sf_dir, docs):
    got = rows_of(queries.op12_license_scan(spark, sf_dir))
    assert got == wanted(docs)
    assert sum(x[1] > 0 for _, x in got) > 1 and any(x[5] != x[4] for _, x in got)


def test_changed_notices(spark):
    """Whole notices, with words changed, dropped and put in, cut, repeated, and across chunks; each at another place."""
    draw, rows = random.Random(5), []
    fill = lambda n: [f"w{draw.randint(0, 50)}" for _ in range(n)]
    for i in range(150):
        text = fill(draw.randint(0, 40))
        for _ in range(draw.randint(1, 3)):
            own = draw.choice(licenses.DEFAULT).text.split()
            for _ in range(draw.choice([0, 0, 1, 2, 8])):
                at = draw.randrange(len(own) + 1)
                own[at : at + draw.randint(0, 1)] = fill(draw.randint(0, 2))
            text += own[: draw.choice([len(own), len(own), len(own) // 2])] + fill(draw.choice([0, 3, 30]))
        rows.append((i, draw.choice([" ", "\n", "-", " … "]).join(text) if i % 3 else " ".join(text).upper()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for chunk in (7, 512):
        got = licenses.licenses(df, chunk=chunk)
        assert rows_of(got) == wanted(df)
    labels = {x for _, r in rows_of(licenses.licenses(df)) for x in r[5].split(",")}
    assert {t.label for t in licenses.DEFAULT} <= labels


@pytest.mark.parametrize("templates", [[Template("one", "w1", True), Template("x", "w2 w3 w4 w5 w6 w7 w8 w9"), Template("none", " - ")], [], [Template("p", "word word", True), Template("q", "word word word word word word word")]])
def test_awkward_rows(awkward, empty, templates):
    """Nulls, long texts, periodic texts, repeated rows; templates of one word, of none, and periodic ones."""
    assert rows_of(licenses.licenses(awkward, templates)) == wanted(awkward, templates)
    assert licenses.licenses(empty, templates).count() == 0 and licenses.license_spans(empty, templates).count() == 0


def test_clean_texts(docs):
    """A document without any word of a license has no label."""
    got = {r.doc_id: r for r in licenses.licenses(docs).collect()}
    for r in docs.collect():
        if not {"license", "licensed", "by", "permission", "software"} & set(words_of(r.text)):
            assert (got[r.doc_id].labels, got[r.doc_id].n_base) == ("", 0)
