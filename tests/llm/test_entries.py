"""The opN_ queries on small tables: the columns of their contracts against brute force."""

import hashlib
import math
import re
import time

import numpy as np

from quire.llm import secrets

DOCS = "doc_id long, text string, lang string, source string, n_chars long, start int, spans string"


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def secret_texts():
    rng = np.random.default_rng(21)
    draw = lambda name, n: "".join(rng.choice(list(secrets.ALPHABETS[name]), n))
    word = lambda: "".join(rng.choice(["tion", "ing", "the", "ed", "er", "an", "schaft"], rng.integers(1, 12)))
    texts = [None, "", "a" * 70000 + " " + draw("base64", 44) + "==", 'token="' + draw("base62", 30) + '"', draw("hex", 40), "AKIA" + draw("base32", 16)]
    for name in secrets.ALPHABETS:
        texts += [" ".join([word(), draw(name, int(n)), word() + "/" + word(), f"{draw(name, 22)}={draw(name, 21)}"]) for n in rng.integers(20, 60, 4)]
    return texts + [" ".join(word() for _ in range(30)) for _ in range(40)] + texts[-1:] * 3


def test_op10_columns_and_step_up(spark, tmp_path):
    texts = secret_texts()
    write(spark, tmp_path, "documents", [(i, t, "en", "s", 1, 2, "x") for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r for r in secrets.op10_secrets(spark, str(tmp_path)).collect()}
    base, found = {}, []
    for i, t in enumerate(texts):
        base[i] = sorted((m.start(), k, m.end()) for k, (p, group, least) in enumerate([(secrets.ASSIGN, 2, 6), ("AKIA[A-Z0-9]+", 0, 20), ("[0-9a-f]+", 0, 24)]) for m in re.finditer(p, t or "", re.ASCII | (re.IGNORECASE if k == 0 else 0)) if len(m[group]) >= least)
        # Every maximal run of every encoding, unless a span of a pattern holds it.
        runs = {m.span() for letters in secrets.ALPHABETS.values() for m in re.finditer(f"[{re.escape(letters)}]{{20,}}", t or "")}
        for s, e in sorted(runs):
            if not any(a <= s and e <= b for a, _, b in base[i]):
                padded = re.compile("={1,2}(?![A-Za-z0-9+/_=-])").match(t, e)
                found.append((i, s, padded.end() if padded else e, secrets.examine(t[s:e])[1]))
    # The step-up rule as written: the largest r such that the r-th smallest p over weight is at most rate * r / n.
    sizes = [min(e - s, 64) for _, s, e, _ in found]
    mean = sum(sizes) / len(sizes)
    ranked = sorted(-min(max(math.floor(-10 * (p - math.log10(w / mean))), 0), 1000) for (_, _, _, p), w in zip(found, sizes))
    last = max((v for r, v in enumerate(ranked, 1) if 10 ** (v / 10) <= secrets.RATE * r / len(ranked)), default=-math.inf)
    hits = {i: [] for i in base}
    for (i, s, e, p), w in zip(found, sizes):
        if -min(max(math.floor(-10 * (p - math.log10(w / mean))), 0), 1000) <= last:
            hits[i].append((s, 3, e))
    assert 40 < sum(map(len, hits.values())) < len(found)
    write_out = lambda spans: ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
    assert set(got) == set(base)
    for i, r in got.items():
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in base[i]) for j in range(3))
        assert r.base_sha256 == hashlib.sha256(write_out(base[i]).encode()).hexdigest()
        assert r.spans == write_out(base[i] + hits[i])


def test_secret_p_values_hold_under_written_text():
    # Drawn from the null hypothesis itself, p-values of at most x are met no oftener than x.
    rng = np.random.default_rng(22)
    share = np.array(secrets._LETTERS) / sum(secrets._LETTERS)
    letters = [list("abcdefghijklmnopqrstuvwxyz"), list("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), list("0123456789"), list("+/-_")]
    p = []
    for _ in range(3000):
        kinds = [int(rng.integers(4))]
        while len(kinds) < 24:
            kinds.append(kinds[-1] if rng.random() < secrets.STAY else int(rng.choice([k for k in range(4) if k != kinds[-1]])))
        token = ""
        for k in kinds:
            step = rng.choice([0, 1, 9, int(rng.integers(2, 9))], p=[*secrets._STEPS, 1 - sum(secrets._STEPS)])
            token += str((int(token[-1]) + step) % 10) if k == 2 and token[-1:].isdigit() else rng.choice(letters[k], p=share if k < 2 else None)
        p.append(10 ** secrets.examine(token)[1])
    assert all(np.mean(np.array(p) <= x) <= x + 3 * math.sqrt(x / len(p)) for x in (0.1, 0.01, 0.001))


def test_long_texts_of_secrets_take_linear_time():
    rng = np.random.default_rng(23)
    keys = "".join(rng.choice(list(secrets.ALPHABETS["base62"]), 30 * 30000))
    parts = [keys[i : i + 30] for i in range(0, len(keys), 30)]
    text = " ".join(f'token="{k}"' if i % 2 else k for i, k in enumerate(parts))
    began = time.process_time()
    base, found = secrets.scan(text)
    assert len(text) > 1_000_000 and len(base) == 15000 and len(found) >= 15000 and time.process_time() - began < 4


def test_op2_columns_scores_and_held_out_quality(spark, tmp_path):
    from quire.llm import classifier

    rng = np.random.default_rng(24)
    word = lambda: "".join(rng.choice(list("abcdefgh"), int(rng.integers(2, 9))))
    # Labels follow the share of one kind of words, with noise, so that no single word decides.
    rows, labels = [], []
    for i in range(1500):
        bad = rng.random()
        text = " ".join(word() + "z" * (rng.random() < bad / 2) for _ in range(80))
        rows.append((i, text, "en", "s", len(text), 0, "x"))
        labels.append((i, int(bad + 0.1 * rng.normal() < 0.5), 0))
    rows += [(2000, None, "en", "s", None, 0, "x"), (2001, "", "en", "s", 0, 0, "x"), (2001, "", "en", "s", 0, 0, "x"), (None, "z" * 300000, "en", "s", 1, 0, "x")]
    write(spark, tmp_path, "documents", rows, DOCS)
    write(spark, tmp_path, "labels", labels, "doc_id long, quality int, toxic int")
    got = classifier.op2_quality(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() >= {"doc_id", "held_out", "score", "predicted"}
    machine = classifier.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    by_id = {r.doc_id: r for r in got}
    for doc_id, text, _, _, n_chars, _, _ in rows[::37] + rows[-4:]:
        at, x = classifier.features(text, n_chars)
        spread = (machine.factor[at] * x[:, None]).astype(np.float64)
        raw = machine.bias + float(machine.weight[at].astype(np.float64) @ x) + float(np.triu(spread @ spread.T, 1).sum())
        r = by_id[doc_id]
        assert abs(r.score - 1 / (1 + math.exp(-raw))) < 1e-5 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (doc_id is not None and __import__("zlib").crc32(str(doc_id).encode()) % 3 == 1)
    tested = sorted((by_id[i].score, y) for i, y, _ in labels if by_id[i].held_out)
    ranks = [k for k, (_, y) in enumerate(tested, 1) if y]
    ones = len(ranks)
    assert (sum(ranks) - ones * (ones + 1) / 2) / (ones * (len(tested) - ones)) > 0.8


def test_op1_op3_op5_op6_op7_op8_op9_columns(spark, tmp_path):
    from quire.llm import chat, mixing, pieces, rules, simhash, suffix, tokens

    shared = "a passage that two of the documents have in common, long enough to be removed from the second one"
    rows = [(1, shared + " one", "en", "s", 9, 0, "x"), (2, "two " + shared, "en", None, 9, 0, "x"), (3, None, None, "s", None, 0, "x"), (3, None, None, "s", None, 0, "x"), (4, "word " * 20000, "de", "s", 1, 0, "x")]
    write(spark, tmp_path, "documents", rows, DOCS)
    write(spark, tmp_path, "conversations", [(7, 0, "user", "hi"), (7, 1, "assistant", None), (8, 0, "user", "</s>")], "conv_id long, turn long, role string, text string")
    folder = str(tmp_path)
    types = lambda df: {f.name: f.dataType.simpleString() for f in df.schema}
    mixed = mixing.op1_mix(spark, folder)
    assert types(mixed) == {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"} and mixed.count() == 5
    judged = rules.op3_rules(spark, folder)
    assert types(judged) == {"doc_id": "bigint", **dict.fromkeys(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), "bigint"), "base_failed": "boolean", "kept": "boolean"} and judged.count() == 5
    talks = {r.conv_id: r for r in chat.op5_chat(spark, folder).collect()}
    assert set(talks) == {-1, 7, 8} and [talks[c].loss_chars for c in (-1, 7, 8)] == [21, 0, 0] and talks[7].n_turns == 2
    assert talks[-1].loss_sha256 == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest()
    coded = pieces.op6_pieces(spark, folder).collect()
    assert len(coded) == 5 and all(r.lossless and r.n_tokens == len(r.ids or []) for r in coded)
    cut = {r.doc_id: r for r in suffix.op7_suffix(spark, folder).collect()}
    assert (cut[1].n_removed, cut[2].n_removed, cut[2].n_spans, cut[3].n_bytes) == (0, len(shared), 1, 0)
    assert cut[2].kept_sha256 == hashlib.sha256(b"two ").hexdigest() and cut[2].n_bytes == len(shared) + 4
    prints = {r.doc_id: r for r in simhash.op8_simhash(spark, folder).collect()}
    assert prints[3].fingerprint == "0" * 16 and prints[3].component_id == 3 and len(prints) == 4
    hist = tokens.op9_tokens(spark, folder).collect()
    assert sum(r.n_docs for r in hist) == 5 and min(r.n_tokens for r in hist) == 0
