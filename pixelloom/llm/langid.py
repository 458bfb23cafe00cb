"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes in both directions with minimally gated units (one gate, which both resets and
updates), labels every position, and a document's probabilities are the mean over all its positions. It is trained here,
in numpy, by backpropagation through time, on a bounded sample of labelled rows: at most `per_language` texts of each
language, an equal number from each of SHARES hashed shares, and a `snippet` of characters from each. Texts are read whole, in segments of SEGMENT bytes that run side by side.

A null text, or one without a letter (category L), is `und` with score 0, and so is every text if nothing is labelled. Languages with
equal probability go to the first in order. Repeated rows are labelled alike; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.llm import _common as C

#: The sample: its bound is per_language rows for each learned language.
PER_LANGUAGE, SNIPPET = 400, 320
WIDTH, SEGMENT, SIDE_BY_SIDE = 8, 128, 2048
#: The sample is drawn alike from so many shares of a language, so that no task ranks all its rows.
SHARES = 16
_LETTER = regex.compile(r"\p{L}")


class Network:
    """Parameters of both directions: tables (byte -> gate and candidate), recurrent weights, and the output layer."""

    def __init__(self, languages: list[str], width: int = WIDTH, seed: int = 7):
        rnd = np.random.default_rng(seed)
        self.languages = languages
        r = lambda *shape, scale: rnd.normal(0, scale, shape).astype(np.float32)
        self.p = {f"{k}{d}": r(256, width, scale=0.3) for k in ("gate", "cand") for d in "fb"}
        self.p |= {f"{k}{d}": r(width, width, scale=0.4) for k in ("ugate", "ucand") for d in "fb"}
        self.p |= {f"out{d}": r(width, len(languages), scale=0.4) for d in "fb"} | {"bias": np.zeros(len(languages), np.float32)}
        for d in "fb":
            self.p[f"gate{d}"] -= 1  # long memory to begin with

    def states(self, x: np.ndarray, d: str, keep: bool = False, active: np.ndarray | None = None):
        """Hidden states of direction d for bytes x (time, batch); with keep, also what training needs. active: how many of
        the batch, longest first, have not ended at each time; what has ended has no state."""
        p, (steps, batch) = self.p, x.shape
        gate, cand, ugate, ucand = p[f"gate{d}"], p[f"cand{d}"], p[f"ugate{d}"], p[f"ucand{d}"]
        width = gate.shape[1]
        h = np.zeros((batch, width), np.float32)
        out = (np.empty if active is None else np.zeros)((steps, batch, width), np.float32)
        kept = [] if keep else None
        half, start, wide_f, wide_c = np.float32(0.5), h, np.empty_like(h), np.empty_like(h)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            n = batch if active is None else int(active[t])
            f, c = wide_f[:n], wide_c[:n]
            h = h[:n] if len(h) >= n else np.concatenate([h, start[len(h) : n]])
            np.take(gate, x[t, :n], axis=0, out=f, mode="clip")
            f += h @ ugate
            f *= half
            np.tanh(f, out=f)
            f += 1
            f *= half
            np.take(cand, x[t, :n], axis=0, out=c, mode="clip")
            c += (f * h) @ ucand
            np.tanh(c, out=c)
            if kept is not None:
                kept.append((t, h, f.copy(), c.copy()))
            c -= h
            c *= f
            h = np.add(h, c, out=out[t, :n])
        return out, kept

    def probabilities(self, x: np.ndarray, active: np.ndarray | None = None) -> np.ndarray:
        """(time, batch, language): the label of every position."""
        hf, hb = self.states(x, "f", active=active)[0], self.states(x, "b", active=active)[0]
        z = hf.reshape(-1, hf.shape[2]) @ self.p["outf"]
        z += hb.reshape(-1, hb.shape[2]) @ self.p["outb"]
        z += self.p["bias"]
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        return z.reshape(*x.shape, -1)

    def gradients(self, x: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions, and its gradients, by backpropagation through time. label: of every position."""
        p, (steps, batch) = self.p, x.shape
        runs = {d: self.states(x, d, keep=True) for d in "fb"}
        z = runs["f"][0] @ p["outf"] + runs["b"][0] @ p["outb"] + p["bias"]
        z = np.exp(z - z.max(2, keepdims=True))
        z /= z.sum(2, keepdims=True)
        at = (np.arange(steps)[:, None], np.arange(batch)[None, :], label)
        loss = float(-np.log(z[at] + 1e-9).mean())
        z[at] -= 1
        z /= steps * batch
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["bias"] = z.sum((0, 1))
        for d in "fb":
            out, kept = runs[d]
            g[f"out{d}"] = out.reshape(steps * batch, -1).T @ z.reshape(steps * batch, -1)
            from_out = z @ p[f"out{d}"].T
            dh = np.zeros_like(out[0])
            for t, h, f, c in reversed(kept):
                dh = dh + from_out[t]
                dc = dh * f * (1 - c * c)
                df = dh * (c - h)
                dg = dc @ p[f"ucand{d}"].T
                g[f"ucand{d}"] += (f * h).T @ dc
                df += dg * h
                da = df * f * (1 - f)
                g[f"ugate{d}"] += h.T @ da
                dh = dh * (1 - f) + dg * f + da @ p[f"ugate{d}"].T
                for k, v in ((f"cand{d}", dc), (f"gate{d}", da)):
                    for j in range(v.shape[1]):
                        g[k][:, j] += np.bincount(x[t], v[:, j], 256)
        return loss, g


def trained(samples: list[tuple[str, str]], steps: int = 200, batch: int = 192, length: int = 64, rate: float = 0.03, seed: int = 3) -> Network:
    """A network for the languages of samples (language, text), by Adam on random windows, every language alike."""
    net = Network(sorted({s[0] for s in samples}))
    by = {k: [np.frombuffer(t.encode(), np.uint8) for lang, t in samples if lang == k and t] for k in net.languages}
    pools = {k: np.concatenate([*v, np.zeros(length, np.uint8)]) for k, v in by.items()}
    rnd = np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        x, label = np.empty((length, batch), np.uint8), np.empty((length, batch), np.int64)
        for i in range(batch):
            turn = int(rnd.integers(1, length)) if i % 3 == 0 else length  # a third of the windows change language
            for a, b in ((0, turn), (turn, length)):
                k = int(rnd.integers(0, len(net.languages)))
                pool = pools[net.languages[k]]
                s = int(rnd.integers(0, len(pool) - length + 1))
                x[a:b, i], label[a:b, i] = pool[s : s + b - a], k
        _, g = net.gradients(x, label)
        now = rate * min(1, 3 * (1 - step / (steps + 1)))
        norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        for k, a in g.items():
            a *= min(1.0, 1.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * a
            v[k] = 0.99 * v[k] + 0.01 * a * a
            net.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def pooled(net: Network, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(document, language): mean over the positions of every document data[off[i]:off[i+1]]."""
    sizes = np.diff(off)
    per = -(-sizes // SEGMENT)
    doc = np.repeat(np.arange(len(sizes)), per)
    start = (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)) * SEGMENT + off[:-1][doc]
    length = np.minimum(SEGMENT, off[1:][doc] - start)
    total = np.zeros((len(sizes), len(net.languages)))
    padded = np.append(data, np.zeros(SEGMENT, np.uint8))
    order = np.argsort(-length, kind="stable")
    for i in range(0, len(doc), SIDE_BY_SIDE):
        of = order[i : i + SIDE_BY_SIDE]
        longest = int(length[of].max())
        step = np.arange(longest)[:, None]
        inside = step < length[of][None, :]
        x = np.where(inside, padded[start[of][None, :] + step], 0).astype(np.uint8)
        z = net.probabilities(x, inside.sum(1))
        if not inside.all():
            z *= inside[:, :, None]
        np.add.at(total, doc[of], z.sum(0, dtype=np.float64))
    return total / np.maximum(sizes, 1)[:, None]


def position_labels(net: Network, text: str) -> list[str]:
    """The language of every byte of a text, read in one piece."""
    x = np.frombuffer(text.encode(), np.uint8)[:, None]
    return [net.languages[i] for i in net.probabilities(x).argmax(2).ravel()] if len(x) else []


def _label(net: Network | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = C.utf8_parts(batch.column(1))
            lang, score = [], []
            for a, b in C.slices(off):
                part = data[off[a] : off[b]]
                probs = pooled(net, part, off[a : b + 1] - off[a]) if net is not None else None
                best = probs.argmax(1) if probs is not None else None
                for i in range(b - a):
                    known = net is not None and _LETTER.search(part[off[a + i] - off[a] : off[a + i + 1] - off[a]].tobytes().decode())
                    lang.append(net.languages[best[i]] if known else "und")
                    score.append(float(min(1.0, probs[i, best[i]])) if known else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["id", "held_out", "lang_pred", "score"])

    return run


def _accept(net: Network | None, text_at: int, least: float):
    """Rows whose language is known well enough, with all their columns."""
    label = _label(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(text_at)
            own = pa.RecordBatch.from_arrays([pa.nulls(len(text), pa.int64()), text, pa.nulls(len(text), pa.bool_())], ["id", "text", "held_out"])
            keep = [lang != "und" and score >= least for out in label([own]) for lang, score in zip(out.column(2).to_pylist(), out.column(3).to_pylist(), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def held_out(id_col: str) -> Column:
    """Rows that training never sees: crc32 of the id as text is divisible by five. A null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, snippet: int = SNIPPET) -> Network | None:
    """A network trained on the bounded sample, or None if no row is labelled."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(~held_out("id") & F.col("lang").isNotNull() & (F.length("text") > 0))
    rows = rows.select("lang", F.xxhash64("id").alias("turn"), F.expr(f"substring(text, cast(1 + pmod(xxhash64(id, 1), greatest(1, length(text) - {snippet})) as int), {snippet})").alias("text"))
    share = F.pmod(F.xxhash64("turn", F.lit(2)), F.lit(SHARES))
    rows = rows.withColumn("share", share).withColumn("n", F.row_number().over(Window.partitionBy("lang", "share").orderBy("turn", "text"))).where(F.col("n") <= -(-per_language // SHARES))
    sample = sorted((r.lang, r.text) for r in rows.select("lang", "text").collect())
    return trained(sample) if sample else None


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", net: Network | None = None, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Per row: id, held_out, lang_pred and score. net: a network to use, else one is learned from docs."""
    net = net or learned(docs, id_col, text_col, lang_col, per_language)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), held_out(id_col).alias("held_out"))
    return rows.mapInArrow(_label(net), "id long, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.3, net: Network | None = None) -> DataFrame:
    """The rows of docs, unchanged, whose text has a language with a score of at least `least`."""
    net = net or learned(docs, id_col, text_col, lang_col)
    return docs.mapInArrow(_accept(net, docs.columns.index(text_col), least), docs.schema)
