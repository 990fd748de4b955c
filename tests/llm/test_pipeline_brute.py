"""``run`` of the corpus pipeline against a plain version of its five stages, on documents with junk, copies, shared passages and odd rows."""

import random
import zlib
from math import comb

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from tideloom.llm import bpe, quality_cnn, quality_rules

from .test_dedup import components, windows_removed
from .test_filters import W, features

WORD = bpe.tokenizer_path("word_bpe_49k.json")


def corpus():
    """(doc_id, text, lang, source, n_chars, n_words) and (doc_id, quality, toxic)."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeioustrlnm") for _ in range(rng.randint(3, 7)))
    words = lambda k: [word() for _ in range(k)]
    passage, texts, labels = words(30), [None, "", " \n", "few words", "again and " * 80], []
    for i in range(330):
        w, good = words(rng.randint(60, 120)), i % 6 != 0
        if not good:
            w = [x + ("###" if i % 12 else "~") for x in w]  # the rules count one of them, the classifier sees both
        elif i % 10 == 1:
            w = [*w[:40], *passage, *w[40:], *words(60)]
        labels.append((len(texts), int(good), 0))
        texts.append(" ".join(w))
        if good and i % 15 == 2:
            texts.append(texts[-1])
        if good and i % 15 == 4:  # a chain: each copy differs from the one before by a word
            for _ in range(4):
                w = texts[-1].split(" ")
                w[rng.randrange(len(w))] = word()
                texts.append(" ".join(w))
    texts.append("\n".join(" ".join(words(12)) for _ in range(400)) + "\n" + " ".join(passage))
    docs = [(i, t, "en" if i % 40 else None, "one", len(t or ""), "clash") for i, t in enumerate(texts)]
    return docs, labels


def kept_by_rules(docs, labels):
    """doc_ids that the base rule and the last allowed level of each stratum keep."""
    seen, within = {}, {}
    for d, t, *_ in docs:
        n, chars, symbols, dup, repeat = features(t)
        lines = sum(bool(W.search(x)) for x in (t or "").split("\n"))
        value = {"symbols": symbols / max(n, 1), "dup_lines": dup / max(lines, 1), "repeats": repeat / max(n, 1), "long_words": chars / max(n, 1)}
        seen[d] = n >= 50 and 100 * repeat <= 50 * n
        within[d] = min(sum(value[r] <= c for c in cuts) for r, (_, cuts) in quality_rules.RULES.items())
    good, lang = {d for d, q, _ in labels if q == 1}, {d: x for d, _, x, *_ in docs}
    strata = {x: [within[d] for d in good if lang[d] == x] for x in {lang[d] for d in good}}
    level = {}
    for x, ws in strata.items():
        for j in range(7):
            k, n, eps = sum(w <= j for w in ws), len(ws), quality_rules.EPS
            if sum(comb(n, i) * eps**i * (1 - eps) ** (n - i) for i in range(k + 1)) > quality_rules.ALPHA / len(strata):
                break
            level[x] = j
    return {d for d in seen if seen[d] and within[d] > level.get(lang[d], -1)}, level


def direct_score(net, text):
    h = quality_cnn.HALF
    halves = -(-(len(text) + 6) // h)
    raw = np.zeros(halves * h + 4, np.uint8)
    raw[3 : 3 + len(text)] = list(text)
    resp = sum(net.weights[k][raw[k : k + halves * h]] for k in range(4))
    chunks = np.array([resp[j * h : min(j + 2, halves) * h].max(0) for j in range(halves)])
    feats = np.maximum(chunks + net.bias, 0)
    return 1 / (1 + np.exp(-(feats.mean(0) @ net.mean + feats.max(0) @ net.top + net.shift)))


def test_run_equals_brute_force(spark, tmp_path):
    docs, labels = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, n_words string").repartition(3)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()

    quality = {d: q for d, q, _ in labels}
    text = {d: t for d, t, *_ in docs}
    kept, level = kept_by_rules(docs, labels)
    assert set(level) == {"en"} and {quality[d] for d in quality if d not in kept} == {0}
    net = quality_cnn.fit(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet")))
    score = {d: direct_score(net, text[d].encode()) for d in kept}
    assert min(abs(s - quality_cnn.CUT) for s in score.values()) > 1e-3
    clean = {d for d in kept if score[d] >= quality_cnn.CUT}
    assert {quality[d] for d in kept - clean} == {0} and not any(quality.get(d) == 0 for d in clean)
    group = components([(d, text[d]) for d in sorted(clean)], 5, 4, 5)
    firsts = [d for d in sorted(clean) if group[d][1] == d]
    assert len(firsts) < len(clean) - 50
    cut = windows_removed([(d, text[d]) for d in firsts], 20)
    assert sum(gone > 0 for _, gone, _ in cut.values()) > 20

    lib, pieces = Tokenizer.from_file(WORD), {(r["doc_id"], r["piece"]): r for r in out}
    assert len(pieces) == len(out)
    total = 0
    for d in firsts:
        ids = lib.encode(cut[d][2] if cut[d][1] else text[d], add_special_tokens=False).ids + [0]
        total += len(ids)
        for p, s in enumerate(range(0, len(ids), 2048)):
            r, part = pieces.pop((d, p)), np.array(ids[s : s + 2048], "<u4")
            assert (r["start"], r["length"], r["ids_crc32"]) == (s, len(part), zlib.crc32(part.tobytes()))
    assert not pieces
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        ends = np.cumsum([n for _, n in sorted(s)])
        assert [o for o, _ in sorted(s)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(sequences) == -(-total // 2048)
