"""Language identification by a bidirectional gated recurrent network over bytes.

Two small GRUs read windows of a text, one forward and one backward; a linear layer on both
states labels every byte, and a document's probabilities are the means over all its bytes. The
network is trained here, in numpy, by backpropagation through time on a bounded sample; every text is
read whole, window after window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.llm.common import slices

#: Units of each direction; bytes of a window; windows read at once.
HIDDEN, WINDOW, ROWS = 8, 128, 2048
#: The fit sees about SAMPLE labelled rows of each language, never more than twice as many, of at most LANGUAGES
#: languages; of each row PLACES windows at hashed places of the whole text.
SAMPLE, LANGUAGES, PLACES = 500, 500, 32
STEPS, BATCH, RATE, SEED = 240, 192, 0.02, 7
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def init(classes: int, hidden: int = HIDDEN, seed: int = SEED) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    out = {}
    for d in "fb":
        out[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)  # update, reset, candidate
        out[f"u{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
        out[f"v{d}"] = rng.normal(0, 0.3, (hidden, classes)).astype(np.float32)
    out["c"] = np.zeros(classes, np.float32)
    return out


def _forward(m: dict, d: str, codes: np.ndarray) -> tuple[np.ndarray, list]:
    """States after each byte, ``(T, R, H)``, and what the way back needs."""
    steps, rows = codes.shape
    hidden = m[f"u{d}"].shape[0]
    x, u = m[f"x{d}"], m[f"u{d}"]
    h, states, tape = np.zeros((rows, hidden), np.float32), np.empty((steps, rows, hidden), np.float32), [None] * steps
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        a, hu = x[codes[t]], h @ u
        gates = _sigmoid(a[:, : 2 * hidden] + hu[:, : 2 * hidden])
        z, r, un = gates[:, :hidden], gates[:, hidden:], hu[:, 2 * hidden :]
        n = np.tanh(a[:, 2 * hidden :] + r * un)
        tape[t] = (h, z, r, un, n)
        h = n + z * (h - n)
        states[t] = h
    return states, tape


def _backward(m: dict, d: str, codes: np.ndarray, tape: list, up: np.ndarray, grad: dict) -> None:
    """Backpropagation through time of one direction; ``up`` is the gradient at the states."""
    steps, rows = codes.shape
    u = m[f"u{d}"]
    hidden = u.shape[0]
    gx, gu = np.zeros_like(m[f"x{d}"]), np.zeros_like(u)
    g = np.zeros((rows, hidden), np.float32)
    for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
        h, z, r, un, n = tape[t]
        g = g + up[t]
        gn = g * (1 - z) * (1 - n * n)
        gz = g * (h - n) * z * (1 - z)
        gr = gn * un * r * (1 - r)
        ga = np.concatenate([gz, gr, gn], axis=1)
        gh = np.concatenate([gz, gr, gn * r], axis=1)
        np.add.at(gx, codes[t], ga)
        gu += h.T @ gh
        g = g * z + gh @ u.T
    grad[f"x{d}"], grad[f"u{d}"] = gx, gu


def loss_and_grad(m: dict, codes: np.ndarray, label: np.ndarray) -> tuple[float, dict]:
    """Mean cross-entropy over all positions of the windows ``codes (T, R)``, and its gradient."""
    fs, ft = _forward(m, "f", codes)
    bs, bt = _forward(m, "b", codes)
    p = _softmax(fs @ m["vf"] + bs @ m["vb"] + m["c"])
    steps, rows, _ = p.shape
    at = np.arange(rows)
    loss = -float(np.log(p[:, at, label] + 1e-9).mean())
    p[:, at, label] -= 1
    p /= steps * rows
    flat = p.reshape(-1, p.shape[-1])
    grad = {"c": flat.sum(0), "vf": fs.reshape(len(flat), -1).T @ flat, "vb": bs.reshape(len(flat), -1).T @ flat}
    _backward(m, "f", codes, ft, p @ m["vf"].T, grad)
    _backward(m, "b", codes, bt, p @ m["vb"].T, grad)
    return loss, grad


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    z /= z.sum(axis=-1, keepdims=True)
    return z


def fit(texts: list[bytes], labels: list[str], steps: int = STEPS, hidden: int = HIDDEN, seed: int = SEED) -> tuple[list[str], dict]:
    """Languages and weights; every batch draws its windows evenly over the languages."""
    names = sorted(set(labels))
    rng = np.random.default_rng(seed)
    m = init(len(names), hidden, seed)
    by = [[np.frombuffer(t, np.uint8) for t, k in zip(texts, labels) if k == name and t] for name in names]
    if len(names) < 2 or not all(by):
        return names, m
    first, second = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    length = WINDOW // 2
    for step in range(1, steps + 1):
        label = rng.integers(0, len(names), BATCH)
        codes = np.zeros((BATCH, length), np.uint8)
        for row, k in zip(codes, label):
            t = by[k][rng.integers(len(by[k]))]
            at = rng.integers(0, max(1, len(t) - length + 1))
            row[: len(t) - at] = t[at : at + length]
        _, grad = loss_and_grad(m, np.ascontiguousarray(codes.T), label)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = RATE * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for k, g in grad.items():
            g = g / max(1.0, norm)
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            m[k] -= (rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return names, m


def _run(m: dict, d: str, codes: np.ndarray, out: np.ndarray) -> None:
    """The states of :func:`_forward` without its tape, in reused memory."""
    steps, rows = codes.shape
    u = m[f"u{d}"]
    hidden = u.shape[0]
    # sigmoid(x) = (1 + tanh(x / 2)) / 2: the halves are put into the weights
    half = np.repeat(np.array([0.5, 0.5, 1.0], np.float32), hidden)
    x, u = m[f"x{d}"] * half, u * half
    h = np.zeros((rows, hidden), np.float32)
    a, hu, n = np.empty((rows, 3 * hidden), np.float32), np.empty((rows, 3 * hidden), np.float32), np.empty((rows, hidden), np.float32)
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        np.take(x, codes[t], axis=0, out=a)
        np.matmul(h, u, out=hu)
        gates = a[:, : 2 * hidden]
        gates += hu[:, : 2 * hidden]
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        np.multiply(a[:, hidden : 2 * hidden], hu[:, 2 * hidden :], out=n)
        n += a[:, 2 * hidden :]
        np.tanh(n, out=n)
        h -= n
        h *= a[:, :hidden]
        h += n
        out[t] = h


def label_positions(m: dict, codes: np.ndarray) -> np.ndarray:
    """Probabilities ``(T, R, languages)`` of every position of the windows ``codes (T, R)``."""
    fs = np.empty((*codes.shape, m["uf"].shape[0]), np.float32)
    bs = np.empty_like(fs)
    _run(m, "f", codes, fs)
    _run(m, "b", codes, bs)
    z = fs @ m["vf"]
    z += bs @ m["vb"]
    z += m["c"]
    np.exp(np.clip(z, -30, 30, out=z), out=z)
    z /= z.sum(axis=-1, keepdims=True)
    return z


def pool(m: dict, texts: list[bytes], window: int = WINDOW) -> np.ndarray:
    """Mean position probabilities of each text; zeros for an empty one."""
    classes = len(m["c"])
    sums, lengths = np.zeros((len(texts), classes)), np.array([len(t) for t in texts])
    windows = -(-lengths // window)
    owner = np.repeat(np.arange(len(texts)), windows)
    if not len(owner):
        return sums
    data = np.zeros((len(owner), window), np.uint8)
    flat, at = data.reshape(-1), 0
    for t, w in zip(texts, windows.tolist()):
        flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
        at += w * window
    left = np.concatenate([np.arange(w) for w in windows.tolist()]) * -window + lengths[owner]
    for lo in range(0, len(owner), ROWS):
        part = data[lo : lo + ROWS]
        p = label_positions(m, np.ascontiguousarray(part.T))
        n = left[lo : lo + ROWS]
        if (n < window).any():
            p *= (np.arange(window)[:, None] < n[None, :])[:, :, None]
        s = p.sum(axis=0)
        for k in range(classes):
            sums[:, k] += np.bincount(owner[lo : lo + ROWS], weights=s[:, k], minlength=len(texts))
    return sums / np.maximum(lengths, 1)[:, None]


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> tuple[list[str], dict]:
    """Fit on about ``sample`` labelled rows of each language that are not held out, chosen by hash of their id.

    Windows are drawn from whole texts. Rows without a text, a language or a letter teach nothing; without any
    such row the model knows no language.
    """
    known = docs.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")).where(F.col("l").isNotNull() & (F.length("t") > 0) & ~held_out("i"))
    counts = {r.l: r.n for r in known.groupBy("l").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not counts:
        return fit([], [])
    share = F.create_map(*(F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1 << 30, -(-(sample << 30) // n)))))
    chosen = known.where(F.pmod(F.xxhash64("i"), F.lit(1 << 30)) < F.element_at(share, F.col("l")))
    place = lambda k: F.substring("t", (F.pmod(F.xxhash64("i", k), F.greatest(F.lit(1), F.length("t") - (WINDOW - 1))) + 1).cast("int"), F.lit(WINDOW))
    windows = F.transform(F.sequence(F.lit(1), F.lit(PLACES)), place)
    rows = chosen.select("l", windows.alias("w")).limit(2 * sample * len(counts)).collect()
    rows = sorted((r.l, list(r.w)) for r in rows)  # the order in which tasks end does not count
    drawn = [(lang, w) for lang, ws in rows for w in ws if _LETTER.search(w)]
    return fit([w.encode() for _, w in drawn], [lang for lang, _ in drawn])


def identify(docs: DataFrame, model: tuple[list[str], dict], id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` per input row, or all columns of ``docs`` and the last two.

    ``und`` (score 1) where the text is null, empty or has no letter, and for every text
    (score 0) if the model knows no language. Texts of any length are read whole. Repeated rows
    stay repeated; an empty table gives an empty result. With ``keep_columns``, columns of ``docs`` that have
    the names of the new ones are replaced; any other names are fine.
    """
    names, m = model

    def predict(texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        plain = [(t or b"") if t and _LETTER.search(t.decode("utf-8", "replace")) else b"" for t in texts]
        p, langs, scores = pool(m, plain), [], []
        for t, row in zip(plain, p):
            k = int(np.argmax(row)) if len(names) else 0
            langs.append(names[k] if t and names else UNKNOWN)
            scores.append(float(row[k]) if t and names else float(not t))
        return langs, scores

    rest = [c for c in docs.columns if c != text_col]
    row = [F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row")] if keep_columns else [F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out")]
    source = docs.select(*row, F.col(text_col).cast("binary").alias("bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "bytes"):
            langs, scores = predict(b.column("bytes").to_pylist())
            kept = b.columns if keep_columns else b.columns[:-1]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names[: len(kept)], "lang_pred", "score"])

    schema = T.StructType([*(source.schema.fields if keep_columns else source.schema.fields[:-1]), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    done = source.mapInArrow(run, schema)
    if keep_columns:
        own = [F.col("bytes").cast("string").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
        done = done.select(*own, "lang_pred", "score")
    return done
