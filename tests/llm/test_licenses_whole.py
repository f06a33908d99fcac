"""Licence texts among other licences and in long prose."""

import random

import pytest

from tracewell.llm.licenses import COVERAGE, TEMPLATES, Index, words

PROSE = "the work and its parts are for all who may use it and or change it in a version of their own to merge a domain ".split()
RARE = "mozilla eclipse affero unencumbered merge domain commons attribution spdx fee accompanying materials".split()


def labels(index, text):
    found = words(text.encode())
    return index.scan(found, (index.vocabulary | index.base_words).intersection(found))


def every_start(text):
    """Brute force: each template at each start."""
    found, out, best = words(text.encode()), set(), 0.0
    for label, keys, own in TEMPLATES:
        own = own.encode().split()
        if not all(f" {k} ".encode() in b" " + b" ".join(found) + b" " for k in keys):
            continue
        share = max(sum(0 <= s + p < len(found) and found[s + p] == w for p, w in enumerate(own)) for s in range(-len(own), len(found) + 1)) / len(own)
        if share >= COVERAGE:
            out.add(label)
            best = max(best, share)
    return out, best


def prose(r, n):
    return " ".join(r.choices(PROSE, k=n))


def text_of(label):
    return max((t for own, _, t in TEMPLATES if own == label), key=len)


@pytest.mark.parametrize("counts", [{}, {w: 90 for w in "license software permission public".split()}])
def test_many_licences(counts):
    """A notices file with all licences, each between long prose, and one whole licence beside other licences' rare words."""
    r, index = random.Random(1), Index(counts, 100)
    every = {label for label, _, _ in TEMPLATES}
    notices = " ".join(prose(r, 200) + " " + text for _, _, text in TEMPLATES)
    assert labels(index, notices)[0] == every
    for label in sorted(every):
        assert label in labels(index, f"{prose(r, 300)} {text_of(label)} {prose(r, 300)} {' x '.join(RARE)}")[0], label


def test_place_with_fewer_votes():
    """A torn copy has all the rarest words in place, the whole one lost two of them."""
    text = text_of("mit").split()
    rarest = set("a and any associated charge copies".split())
    index = Index({w: 50 for w in text if w not in rarest}, 100)
    torn = " ".join(w if w in rarest or k < 7 else "x" for k, w in enumerate(text))
    whole = " ".join("x" if w in ("any", "associated") else w for w in text)
    for text in (f"{torn} y y {whole}", f"{whole} y {torn} {torn}"):
        assert labels(index, text) == every_start(text)
        assert labels(index, text)[0] == {"mit"}


def test_equals_every_start():
    r, index = random.Random(2), Index({"license": 50, "software": 30}, 100)
    seen = set()
    for _ in range(300):
        parts = []
        for _ in range(r.randint(1, 4)):
            text = r.choice(TEMPLATES)[2].split()
            hit = r.choice([0, 0.1, 0.2, 0.3])
            parts += [w if r.random() >= hit else r.choice([*RARE, "x"]) for w in text][r.choice([0, 0, 3]) :] + r.choices([*PROSE, *RARE], k=r.randint(0, 60))
        got = labels(index, " ".join(parts))
        assert got == every_start(" ".join(parts))
        seen |= got[0]
    assert len(seen) > 8


def test_postings_lead_only_to_templates_of_the_files_words(monkeypatch):
    """The work on a file does not grow with templates that share no indexed word with it."""
    from tracewell.llm import licenses

    seen = []
    monkeypatch.setattr(licenses, "_in_place", lambda found, text, start, own=licenses._in_place: seen.append(len(text)) or own(found, text, start))
    more = [(f"l{k}", [f"key{k}"], " ".join(f"w{k}x{j}" for j in range(50))) for k in range(3000)]
    index = Index({}, 100, templates=[*TEMPLATES, *more])
    assert sum(len(p) for p in index.postings.values()) == sum(map(len, index.rare))
    whole = " ".join(["prose"] * 100 + ["key7"] + [f"w7x{j}" if j % 6 else "torn" for j in range(50)])
    assert labels(index, whole) == ({"l7"}, 41 / 50)
    assert len(seen) <= 3 and labels(index, "prose of no licence") == (set(), 0.0)


def test_whole_texts_pass_and_torn_ones_do_not():
    from tracewell.llm.license_texts import WHOLE

    index = Index({}, 100)
    for label, _, text in WHOLE:
        assert labels(index, "file of x\n// " + text.upper().replace(" ", "\n * ")) [0] >= {label}, label
        assert labels(index, text)[1] == 1.0
    mit = WHOLE[0][2]
    assert labels(index, mit.replace("sublicense", "lend"))[1] > 0.99
    assert labels(index, " ".join(w for k, w in enumerate(mit.split()) if k % 3))[0] == set()
