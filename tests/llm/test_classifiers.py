import re
import zlib

import numpy as np
import pytest
from comparing import DATA

from tallyweave.llm import quality, toxicity
from tallyweave.llm import textscan as ts
from tallyweave.llm.queries import op5_quality, op9_toxicity
from tallyweave.session import table


def auc(score, y):
    order = np.argsort(np.argsort(np.concatenate([score])))  # ties are rare here
    pos = y == 1
    return (order[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.mark.parametrize(("query", "label", "parts", "rest", "least"), [(op5_quality, "quality", 3, 1, 0.85), (op9_toxicity, "toxic", 5, 0, 0.95)])
def test_held_out_accuracy(spark, query, label, parts, rest, least):
    sf = str(DATA / "sf0.1")
    rows = query(spark, sf).join(table(spark, sf, "labels").select("doc_id", label), "doc_id", "left").toPandas()
    assert len(rows) == table(spark, sf, "documents").count()
    assert (rows["held_out"] == [zlib.crc32(str(k).encode()) % parts == rest for k in rows["doc_id"]]).all()
    assert rows["score"].between(0, 1).all()
    assert (rows["predicted"] == (rows["score"] >= 0.5)).all()
    test = rows[rows["held_out"] & rows[label].notna()]
    y = test[label].to_numpy()
    print(label, "held out:", len(test), "share right:", (test["predicted"] == y).mean(), "AUC:", auc(test["score"].to_numpy(), y), "recall:", test["predicted"][y == 1].mean(), "kept:", 1 - test["predicted"][y == 0].mean())
    assert (test["predicted"] == y).mean() >= least


@pytest.mark.parametrize(("module", "label", "parts", "rest"), [(quality, "quality", 3, 1), (toxicity, "toxic", 5, 0)])
def test_odd_rows(spark, odd, nothing, module, label, parts, rest):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1), (6, 0), (7, None), (None, 1), (10, 0), (99, 1)], f"doc_id long, {label} int")
    for some in (labels, labels.where(f"{label} = 1"), labels.limit(0)):
        rows = module.classify(odd, some, parts, rest).collect()
        assert len(rows) == odd.count()
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert module.classify(nothing, labels, parts, rest).count() == 0
    keep = quality.keep_good if module is quality else toxicity.drop_toxic
    assert keep(odd, labels, parts=parts, rest=rest).columns == odd.columns


def test_scores_do_not_depend_on_other_columns(spark, odd):
    labels = spark.createDataFrame([(1, 1), (6, 0), (7, 0), (8, 1)], "doc_id long, quality int")
    net = quality.fit(odd, labels)
    a = {r["text"]: r["s"] for r in quality.score(odd, net, to="s").collect()}
    b = {r["text"]: r["s"] for r in quality.score(odd.selectExpr("doc_id + 5 as doc_id", "text"), net, to="s").collect()}
    assert a == b


def plain_tokens(text):
    """Runs of letters, digits or other signs, with marks after words in capitals and repeated words, as (kind, text)."""
    out, before = [], None
    for m in re.finditer(r"[A-Za-z\x80-\U0010ffff]+|[0-9]+|[!-/:-@\[-`{-~]+", text):
        run = m[0]
        out.append(run.translate(ASCII_LOWER))
        if not re.match(r"[A-Za-z\x80-\U0010ffff]", run):
            continue
        upper, plain = len(re.findall("[A-Z]", run)), len(re.findall(r"[\x00-\x7f]", run))
        if run.translate(ASCII_LOWER) == before:
            out.append(SAME)
        elif upper >= 2 and 2 * upper > plain:
            out.append(CAPS)
        before = run.translate(ASCII_LOWER)
    return out


ASCII_LOWER = {i: i + 32 for i in range(65, 91)}
CAPS, SAME = ("caps",), ("same",)


def token_hash(token):
    if token in (CAPS, SAME):
        return int(ts.mix(np.array([quality.CAPS if token is CAPS else quality.SAME], np.uint64))[0])
    data = np.frombuffer(token.encode(), np.uint8)
    return int(ts.hashes(data, np.array([0]), np.array([len(data)]))[0])


def test_quality_scores_against_plain_python(spark):
    """Vectors, pooling and the network once more, word by word, for every document of a table."""
    docs, labels = table(spark, str(DATA / "sf0.001"), "documents"), table(spark, str(DATA / "sf0.001"), "labels")
    net = quality.fit(docs, labels)
    got = {r["doc_id"]: r["s"] for r in quality.score(docs, net, to="s").collect()}
    texts = {r["doc_id"]: plain_tokens(r["text"] or "") for r in docs.collect()}
    known = {int(h): i for i, h in enumerate(net.words)}
    hashes = {t: token_hash(t) for tokens in texts.values() for t in tokens}
    row = {t: known.get(h, len(known) + h % quality.SHARED) for t, h in hashes.items()}
    entry = {t: quality.index(np.array([h], np.uint64)) for t, h in hashes.items()}
    sums, seen = {}, {}
    for tokens in texts.values():
        for i, t in enumerate(tokens):
            seen[row[t]] = seen.get(row[t], 0) + 1
            v = sums.setdefault(row[t], np.zeros(quality.DIM))
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(tokens):
                    at, sign = entry[tokens[j]]
                    for k in range(2):
                        v[at[k, 0]] += sign[k, 0]
    unit = {r: v / max(np.linalg.norm(v), 1) for r, v in sums.items()}
    mean = sum(unit[r] * n for r, n in seen.items()) / sum(seen.values())
    for key, tokens in texts.items():
        x = np.zeros(2 * quality.DIM + 1)
        if tokens:
            v = np.array([unit[row[t]] - mean for t in tokens])
            x = np.concatenate([v.mean(0), v.std(0), [np.log1p(len(tokens))]])
        hidden = np.maximum((x - net.centre) / net.scale @ net.w1 + net.b1, 0)
        expected = 1 / (1 + np.exp(-np.clip((hidden @ net.w2 + net.b2) / net.temperature, -30, 30)))
        assert abs(got[key] - expected) < 2e-3, key


def test_toxicity_scores_against_plain_python(spark):
    """Features and trees once more, text by text, for every document of a table."""
    docs, labels = table(spark, str(DATA / "sf0.01"), "documents"), table(spark, str(DATA / "sf0.01"), "labels")
    model = toxicity.fit(docs, labels)
    assert model.split and model.flat is None
    got = {r["doc_id"]: (r["text"] or "", r["s"]) for r in toxicity.score(docs, model, to="s").collect()}
    lexicon = {kind: dict(zip(h.tolist(), w.tolist(), strict=True)) for kind, (h, w) in model.lexicon.items()}
    abuse, second = set(toxicity.ABUSE), set(toxicity.SECOND_PERSON)
    leet = dict(zip("0134578@$!", "oieastbasi", strict=True))
    letter = r"A-Za-z\x80-\U0010ffff"

    def features(text):
        words = [w.translate(ASCII_LOWER) for w in re.findall(f"[{letter}]+", text)]
        if not words:
            return [0.0] * toxicity.FEATURES
        n, size = len(words), len(text.encode())
        x, hit = [], [w in abuse for w in words]
        for kind in (0, *toxicity.BEGINNINGS):
            count, weight = 0, 0.0
            for i, w in enumerate(words):
                b = w.encode()
                if kind and len(b) <= kind:
                    continue
                data = np.frombuffer(b[:kind] if kind else b, np.uint8)
                h = int(ts.hashes(data, np.array([0]), np.array([len(data)]))[0]) ^ kind
                if h in lexicon.get(kind, {}):
                    count, weight, hit[i] = count + 1, weight + lexicon[kind][h], True
            x += [count / n, weight / n]
        close = sum(h and any(w in second for w in words[max(0, i - 3) : i + 4]) for i, h in enumerate(hit))
        letters = len("".join(re.findall(f"[{letter}]", text)).encode())
        inner = re.findall(f"(?<=[{letter}])[0134578@$!](?=[{letter}])", text)
        hidden = 0
        for run in re.findall(f"(?:[{letter}]|(?<=[{letter}])[0134578@$!](?=[{letter}]))+", text):
            if re.search("[0134578@$!]", run):
                plain = "".join(leet.get(c, c) for c in run).translate(ASCII_LOWER)
                data = np.frombuffer(plain.encode(), np.uint8)
                hidden += plain in abuse or int(ts.hashes(data, np.array([0]), np.array([len(data)]))[0]) in lexicon.get(0, {})
        x += [sum(w in abuse for w in words) / n, sum(hit) / n, np.log1p(sum(hit)), close / n]
        x += [len(re.findall("[A-Z]", text)) / max(letters, 1), len(re.findall(r"[!-/:-@\[-`{-~]", text)) / size, len(re.findall("[!?]", text)) / size]
        return [*x, len(inner) / n, hidden / n, np.log1p(n), sum(w in second for w in words) / n]

    def scored(x):
        m = model.start
        for split, cut, leaf in zip(model.split, model.cut, model.leaf, strict=True):
            node = 0
            for _ in range(toxicity.DEPTH):
                node = 2 * node + (2 if x[split[node]] > cut[node] else 1)
            m += leaf[node - (2**toxicity.DEPTH - 1)]
        return 1 / (1 + np.exp(-m)) if model.at is None else float(np.interp(m, model.at, model.level))

    wrong = [k for k, (text, s) in got.items() if abs(scored(features(text)) - s) > 1e-6]
    assert not wrong, (len(wrong), wrong[:5])


def test_isotonic_steps():
    at, level = toxicity.isotonic(np.array([1.0, 2, 3, 4, 4]), np.array([0.0, 1, 0, 1, 0]))
    assert (np.diff(level) >= 0).all() and (np.diff(at) >= 0).all()
    assert np.interp(2.5, at, level) == 0.5
