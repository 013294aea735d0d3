import math
import re

import pytest
import xxhash

from conftest import SF01
from kestrel.llm.licenses import HARD_NEGATIVES, MIN_PROBABILITY, MIN_SIMILARITY, OTHER, TEMPLATES, fit, scan, scan_documents

#: What the given documents state.
STATED = {"Licensed under CC BY-NC 4.0.": "cc-by-nc", "This work is licensed under the GNU General Public License, version 3.": "gpl",
          "Licensed under the Apache License, Version 2.0.": "apache", "Released under the MIT License.": "mit"}


@pytest.fixture(scope="module")
def model(shared):
    return fit(shared, shared.read.parquet(f"{SF01}/documents.parquet"))


def plain(model, text):
    """Predictions line by line."""
    out = []
    for no, line in enumerate((text or "").split("\n")):
        w = re.findall("[a-z0-9]+(?:[.-][a-z0-9]+)*", line.lower())
        grams = {" ".join(w[i:i + n]) for n in (2, 3) for i in range(len(w) - n + 1)}
        hit = sorted(i for i, f in enumerate(model.features) if f in grams)
        if not hit:
            continue
        z = [b + sum(row[i] for i in hit) for row, b in zip(model.weights, model.intercepts)]
        best = z.index(max(z))
        p = 1 / sum(math.exp((x - max(z)) / model.temperature) for x in z)
        if best and p >= MIN_PROBABILITY:
            s = max(len(set(hit) & t) / len(t) for t in model.templates[model.classes[best]])
            out.append((no, model.classes[best], round(p, 6), round(s, 6), s >= MIN_SIMILARITY))
    return out


def test_equals_plain_scoring(docs_of, model):
    rows = [(i, f"Some text.\n{t}\nMore of the same.") for i, t in enumerate(STATED)]
    rows += [(100 + i, t) for i, t in enumerate(HARD_NEGATIVES)] + [(200 + i, "é " + t.upper() + " !") for i, t in enumerate(x for ts in TEMPLATES.values() for x in ts)]
    rows += [(300, None), (301, ""), (302, "\n\n"), (303, "the of and " * 20000 + "\nReleased under the MIT License."), (304, "Released under the  MIT license"), rows[0], rows[0]]
    got = sorted((r.doc_id, r.line_no, r.family, r.similarity, r.confirmed) for r in scan(docs_of(rows), model).collect())
    want = sorted((i, no, f, s, c) for i, t in rows for no, f, _, s, c in plain(model, t))
    assert got == want
    by_id = {g[0]: g for g in got}
    assert all(by_id[i][1:3] == (1, family) and by_id[i][4] for i, family in enumerate(STATED.values()))
    assert not any(100 <= i < 200 for i in by_id) and by_id[303][1] == 1
    assert scan(docs_of([]).limit(0), model).count() == 0


def test_families_and_licences_that_are_none(docs_of, model):
    stated = ["This work is licensed under the GNU Affero General Public License, version 3.", "Licensed under CC BY-SA 4.0.", "Licensed under CC BY-ND 4.0.", "Released under the ISC License.",
              "Licensed under the Eclipse Public License, version 2.0.", "The Software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the "
              "warranties of merchantability, fitness for a particular purpose and noninfringement."]
    none = ["Released under the zlib License.", "Licensed under the Boost Software License, Version 1.0.", "This work is licensed under the Server Side Public License, version 1.",
            "Licensed under the Common Public License, version 1.0.", "This work is licensed under the GNU Free Documentation License, version 1.3.", "Licensed under CC BY-NC-ND 4.0."]
    got = {r.doc_id: r.family for r in scan(docs_of(list(enumerate(stated + none))), model).collect() if r.confirmed}
    assert got == dict(enumerate(["agpl", "cc-by-sa", "cc-by-nd", "isc", "epl", "mit"]))


def test_given_documents(shared, model):
    docs = shared.read.parquet(f"{SF01}/documents.parquet")
    truth = {(r.doc_id, no): STATED[line] for r in docs.collect() for no, line in enumerate(r.text.split("\n")) if line in STATED}
    got = {(r.doc_id, r.line_no): r.family for r in scan(docs, model).collect() if r.confirmed}
    assert truth and got == truth


def test_fit_without_corpus_and_features(shared, docs_of, model):
    assert scan_documents(docs_of([]).limit(0)).count() == 0
    assert model.hashes == [h - (1 << 64) if h >> 63 else h for h in (xxhash.xxh64_intdigest(f.encode(), 42) for f in model.features)]
    assert model.classes[0] == OTHER
    plan = scan(docs_of([(1, "x")]), model)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange hash", plan)
