"""Operators that judge or change single documents: mixing, quality rules, personal data."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.helpers import ODD_ROWS, odd_documents, write
from tracewell.llm import queries as q
from tracewell.llm.mixing import source_targets, take_copies
from tracewell.llm.pii import FEATURES, KINDS, find_spans, fit, redact
from tracewell.llm.quality import CLASSES, ORDER, Model, gram_codes, keep_good

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    """By resharing the excess until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), dict.fromkeys(order, 0.0)
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def check_mix(rows, got):
    size_of = [(r[0], len(WORD.findall(r[1] or "")), r[-1]) for r in rows]
    assert sorted(((r.doc_id, r["size"], r.source) for r in got), key=str) == sorted(size_of, key=str)
    total = Counter()
    for _, n, s in size_of:
        total[s] += n
    targets, taken, largest = brute_targets(dict(total)), Counter(), defaultdict(int)
    for r in got:
        assert r.source_size == total[r.source] and math.isclose(r.target, targets[r.source], rel_tol=1e-9, abs_tol=1e-6)
        assert r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    for s, t in targets.items():
        assert abs(taken[s] - t) <= largest[s]


def test_mixing(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()
    got = q.op2_pivotal_mixing(spark, sf_dir).collect()
    check_mix(rows, got)
    assert sorted(map(str, got)) == sorted(map(str, q.op2_pivotal_mixing(spark, sf_dir).collect()))
    check_mix(ODD_ROWS, q.op2_pivotal_mixing(spark, write(spark, odd_documents(spark), tmp_path)).collect())
    assert q.op2_pivotal_mixing(spark, write(spark, odd_documents(spark, []), tmp_path / "e")).count() == 0


def test_mixing_in_many_levels(spark):
    """Over 48 * 48 documents of a source: three levels; the expectation of each document holds over seeds."""
    rows = [(i, "w " * (1 + i % 7), "en", "a" if i % 3 else "b") for i in range(9000)]
    docs = odd_documents(spark, rows)
    from tracewell.llm.mixing import mix

    got = mix(docs, share=0.7).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 7 for s, t in target.items())
    rate = Counter()
    for seed in range(6):
        for r in mix(docs, share=0.7, seed=seed).where("source = 'a'").groupBy("size").agg({"copies": "avg"}).collect():
            rate[r["size"]] += r["avg(copies)"] / 6
    want = target["a"] / sum(1 + i % 7 for i in range(9000) if i % 3)
    assert all(abs(v - want) < 0.03 for v in rate.values())


def test_target_caps(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 500), ("c", 40), (None, 5), ("é", 0)], "source string, size long")
    want = brute_targets({"a": 10, "b": 500, "c": 40, None: 5, "é": 0})
    assert all(math.isclose(r.target, want[r.source], rel_tol=1e-9) for r in source_targets(sizes).collect())


def test_take_copies_keeps_columns(spark):
    docs = odd_documents(spark, [(i, "a b c", "en", "s") for i in range(200)])
    out = take_copies(docs)
    assert out.columns == docs.columns and out.count() == 300
    assert take_copies(odd_documents(spark)).columns == docs.columns


def base_quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] >= 2:
            hit |= {i, i + 1, i + 2}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_quality(spark, sf_dir, tmp_path):
    for k, rows in enumerate([ODD_ROWS, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]):
        got = q.op3_perplexity_rules(spark, sf_dir if k else write(spark, odd_documents(spark), tmp_path)).collect()
        assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(((r[0], *base_quality(r[1])) for r in rows), key=str)
        assert not any(r.kept and r.base_failed for r in got)
    assert q.op3_perplexity_rules(spark, write(spark, odd_documents(spark, []), tmp_path / "e")).count() == 0


def test_kept_equals_brute_force(spark, sf_dir):
    """Bands, perplexities and verdicts of the whole table, one document after the other from the model's formula."""
    from tracewell.llm import quality as Q

    rows = [(r.doc_id, r.lang, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    grams = Counter(c for _, _, t in rows for c in gram_codes(t).tolist())
    model = Model(np.array(list(grams)), np.array(list(grams.values())))
    want = {}
    for i, lang, t in rows:
        parts = [round(float(x) * Q.PARTS) for x in model.log_probability(gram_codes(t))]
        want[i] = lang, base_quality(t)[-1], -sum(parts) / Q.PARTS / len(parts) if parts else None
    band = {}
    for lang in {x[0] for x in want.values()} | {"*"}:
        bins = sorted(math.floor(v * Q.BINS) for at, failed, v in want.values() if not failed and lang in (at, "*"))
        if bins and (len(bins) >= Q.LEAST_DOCS or lang == "*"):
            q1, q3 = (bins[math.ceil(len(bins) * share) - 1] / Q.BINS for share in (0.25, 0.75))
            reach = max((q3 - q1) * Q.FENCE, Q.LEAST_FENCE)
            band[lang] = q1 - reach, q3 + reach
    got = q.op3_perplexity_rules(spark, sf_dir).collect()
    assert len(got) == len(want)
    for r in got:
        lang, failed, value = want[r.doc_id]
        low, high = band.get(lang, band["*"])
        assert r.log_perplexity == pytest.approx(value, abs=1e-9) and r.kept == (not failed and (value is None or low <= value <= high))
    same = defaultdict(set)
    for r in got:
        same[next(t for i, _, t in rows if i == r.doc_id)].add(r.log_perplexity)
    assert all(len(v) == 1 for v in same.values())


def test_perplexity_finds_noise_and_keeps_clean(spark):
    rng = np.random.default_rng(5)
    parts = ["ther", "on", "is", "and", "re", "ing", "a", "tion"]
    clean = [(i, " ".join("".join(rng.choice(parts, 2)) for _ in range(80)), "en", "s") for i in range(200)]
    noise = [(1000 + i, " ".join("".join(rng.choice(list("qxzjkvw%$#&"), 5)) for _ in range(80)), "en", "s") for i in range(3)]
    flat = [(2000, " ".join("a" * (i % 9 + 3) + "aa" * (i // 9) for i in range(60)), "en", "s")]
    kept = {r.doc_id for r in keep_good(odd_documents(spark, clean + noise + flat)).collect()}
    assert kept == {r[0] for r in clean}


def test_model_is_a_distribution_and_equals_the_formula():
    text = "the cat sat on the mat. the dog sat on the log. 12 & é"
    codes = gram_codes(text)
    count = Counter(codes.tolist())
    model = Model(np.array(list(count)), np.array(list(count.values())))
    for context in (codes[5] // CLASSES, 12345, 0):
        assert abs(np.exp(model.log_probability(context * CLASSES + np.arange(CLASSES))).sum() - 1) < 1e-4

    def brute(code, n, levels):
        if n == 0:
            return 1 / CLASSES
        c = levels[n]
        of = [sum(1 for v in c.values() if v == k) for k in (1, 2, 3, 4)]
        y = of[0] / (of[0] + 2 * of[1]) if of[0] else 0
        cut = [0] + [min(k, max(0, k - (k + 1) * y * of[k] / of[k - 1])) if of[k - 1] else 0 for k in (1, 2, 3)]
        own = {w: c.get(code // CLASSES * CLASSES + w, 0) for w in range(CLASSES)}
        total = sum(own.values())
        lower = brute(code % CLASSES ** (n - 1), n - 1, levels)
        if not total:
            return lower
        gamma = max(sum(cut[min(v, 3)] for v in own.values()) / total, 1e-9)
        v = own[code % CLASSES]
        return (v - cut[min(v, 3)]) / total + gamma * lower

    levels = {ORDER: count}
    for n in range(ORDER - 1, 0, -1):
        levels[n] = Counter(code % CLASSES**n for code in levels[n + 1])
    for code in [*codes[:20].tolist(), 777]:
        assert math.isclose(math.exp(model.log_probability(np.array([code]))[0]), brute(code, ORDER, levels), rel_tol=1e-4)


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_pii(text):
    spans = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern.replace("\\x20", " "), text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            spans.append((m.start(), rank, m.end(), kind))
    joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))
    return (*(sum(1 for x in spans if x[3] == k) for k in BASE), hashlib.sha256(joined.encode()).hexdigest()), joined


PRIVATE = [
    (20, "a@b.c_d@e.f g@h..i x.y+z%@mail-8.example.com. @a.b é😀q@r.st", "en", "a"),
    (21, "ip 1.2.3.4.5.6.7.8 256.1.1.1 010.0.0.255 1.2.3 9.9.9.9999", "en", "a"),
    (22, "4111 1111 1111 1111, 4111-1111-1111-1112 4041894974608795 12345678901234567890 5 5 5", "en", "a"),
    (23, "+1 (389) 555-5010, +49 30 1234567890123456, +1-2, +123456789012 +44.20.7946.0958)", "en", "a"),
    (24, "9" * 30_000 + " " + "1.2." * 5_000 + "a." * 10_000 + "@" + "x-" * 5000, "en", "a"),
    (25, "+" + "1 " * 20_000 + "x", "en", "a"),
    (26, " 1.2.3.4  a@b.co é", "en", "a"),
]


def test_personal_data(spark, sf_dir, tmp_path):
    for k, rows in enumerate([[*ODD_ROWS, *PRIVATE], spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]):
        got = q.op5_weak_supervision(spark, sf_dir if k else write(spark, odd_documents(spark, rows), tmp_path)).collect()
        assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(((r[0], *base_pii(r[1])[0]) for r in rows), key=str)
        if not k:
            by_id = {r.doc_id: r.spans.split(",") for r in got}
            assert all(set(base_pii(t)[1].split(",")) <= set(by_id[i]) for i, t, *_ in PRIVATE)
    assert q.op5_weak_supervision(spark, write(spark, odd_documents(spark, []), tmp_path / "e")).count() == 0


def test_reliabilities_are_found():
    """Votes drawn from known reliabilities: EM ranks the labelers and the classifier agrees with the truth."""
    rng = np.random.default_rng(2)
    counts, truth = Counter(), Counter()
    for _ in range(20_000):
        y = rng.random() < 0.6
        votes = tuple(int(v if y == (rng.random() < a) or not v else v) * (1 if (rng.random() < a) == y else -1) if v else 0 for a, v in ((0.95, 1), (0.8, rng.random() < 0.7), (0.65, rng.random() < 0.5)))
        counts["phone", *votes] += 1
        truth["phone", *votes] += y
    table, weights = fit([(*k, n) for k, n in sorted(counts.items())])
    accuracy = [table[x, True][1] / (1 - table[x, True][0]) if x == "regex" else table[x, True][1] / (table[x, True][1] + table[x, True][-1]) for x in ("regex", "gazetteer", "context")]
    assert accuracy[0] > accuracy[1] > accuracy[2] > 0.5
    assert weights[-3] > weights[-2] > 0
    right = sum(max(0, truth[k] if weights[KINDS.index("phone")] + sum(w * v for w, v in zip(weights[-3:], k[1:])) > 0 else counts[k] - truth[k]) for k in counts)
    assert right / 20_000 > 0.9


def test_redaction(spark):
    docs = odd_documents(spark, [*ODD_ROWS, (30, "write to é.ann@x.org or call +1 (389) 555-5010 now", "en", "a"), (31, "nothing 12 here", "en", "a")])
    out = redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    by_id = {r.doc_id: r for r in out.collect()}
    assert by_id[30].text == "write to é[EMAIL] or call [PHONE] now" and by_id[30].n_chars == len(by_id[30].text)
    assert by_id[31].text == "nothing 12 here" and by_id[2].text is None


@pytest.mark.parametrize("bad", [[], [("email", 1, 1, 1, 5)]])
def test_fit_on_little(bad):
    assert len(fit(bad)[1]) == len(KINDS) + sum(FEATURES.values()) + 3


def marked(rng, kind):
    """A text with one planted value, and the value's place."""
    words = lambda: " ".join("".join(rng.choice(list("abcdefghilmnoprstu"), rng.integers(2, 9))) for _ in range(rng.integers(4, 30)))
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    before, value = {
        "ssn": ("his ssn is ", f"{rng.integers(100, 600)}-{rng.integers(10, 99)}-{rng.integers(1000, 9999)}"),
        "phone": ("call me at ", f"({rng.integers(200, 900)}) {rng.integers(200, 900)}-{rng.integers(1000, 9999)}"),
        "iban": ("my iban: ", f"DE{digits(2)} {digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}"),
        "name": ("my name is ", f"{rng.choice(['Anna', 'Robert', 'Maria', 'John'])} {rng.choice(['Smith', 'Garcia', 'Weber'])}"),
        "secret": ("with ", "token = " + "".join(rng.choice(list("0123456789abcdef"), 40))),
    }[kind]
    head = words() + " " + before
    return head + value + " " + words(), (kind, len(head), len(head) + len(value))


def test_added_spans_have_precision_and_recall(spark):
    """Planted values of the kinds that only the method finds, and texts with look-alikes that hold none."""
    rng = np.random.default_rng(8)
    rows, want = [], set()
    for i in range(300):
        text, (kind, a, b) = marked(rng, ["ssn", "phone", "iban", "name", "secret"][i % 5])
        rows.append((i, text, "en", "a"))
        want.add((i, f"{kind}:{a}:{b}"))
    for i in range(300, 400):
        n = rng.integers(1000, 9999, 4)
        rows.append((i, f"order {n[0]}-{n[1] % 90 + 10}-{n[2]} version {n[0] % 9}.{n[1] % 9} page {n[3]} chapter 12 token of thanks, secret garden, isbn 978-{n[0]}-{n[1]}", "en", "a"))
    got = {(r.doc_id, x) for r in find_spans(odd_documents(spark, rows)).collect() for x in r.spans.split(",") if x}
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.9 * len(got)


def test_many_matches_in_one_text(spark):
    text = "1.2.3.4 x " * 20_000
    row = find_spans(odd_documents(spark, [(1, text, "en", "a")])).collect()[0]
    assert row.n_ip == 20_000 and row.spans.startswith("ip:0:7,ip:10:17,") and row.spans.endswith("ip:199990:199997")


def test_mixing_of_hot_rows_and_clashing_columns(spark):
    """Rows without an id and of one size, and one row many times over: copies meet the target, columns stay."""
    from pyspark.sql import functions as F

    from tracewell.llm.mixing import mix

    rows = [(None, f"a b {i}", "en", "s") for i in range(2000)] + [(7, "same text here", "en", "s")] * 2000 + [(8, "w " * 30, "en", "t")]
    docs = odd_documents(spark, rows).withColumns({c: F.lit("mine") for c in ("mix_words", "mix_copy", "copies", "row", "t", "step", "found", "pii_spans")})
    got = mix(docs, share=0.6)
    check_mix_share = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("size")).collect()
    assert all(abs(r.taken - r.target) <= r["size"] for r in check_mix_share)
    out = take_copies(docs, share=0.6)
    assert out.columns == docs.columns and out.where("mix_words <> 'mine' or copies <> 'mine' or row <> 'mine' or t <> 'mine'").count() == 0
    want = Counter()
    for r in got.collect():
        want[r.doc_id, r["size"]] += r.copies
    have = Counter((r.doc_id, len(WORD.findall(r.text))) for r in out.collect())
    assert have == +want
    assert redact(docs).where("found <> 'mine' or pii_spans <> 'mine' or row <> 'mine'").count() == 0
