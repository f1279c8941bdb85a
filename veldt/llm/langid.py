"""The language of every document and of every stretch of a mixed one.

A byte convolutional network (byte embedding, filters of several widths, maximum over a window, softmax) is trained in
numpy on sentences of labelled documents and applied to fixed-length windows of all sentences. A shortest path over the
sentences of a text, with a price for each change, turns their scores into segments.
"""

import math
import pickle
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldt.session import col, spread

LANGS = ("de", "en", "es", "fr", "it", "ja", "pt", "ru")
# Names and codes of the languages, in lower case.
ALIASES = {
    "en": "en", "eng": "en", "english": "en", "anglais": "en", "inglés": "en", "englisch": "en",
    "es": "es", "spa": "es", "spanish": "es", "español": "es", "espanol": "es", "castellano": "es", "castilian": "es",
    "pt": "pt", "por": "pt", "portuguese": "pt", "português": "pt", "portugues": "pt",
    "fr": "fr", "fra": "fr", "fre": "fr", "french": "fr", "français": "fr", "francais": "fr",
    "de": "de", "deu": "de", "ger": "de", "german": "de", "deutsch": "de",
    "it": "it", "ita": "it", "italian": "it", "italiano": "it",
    "ru": "ru", "rus": "ru", "russian": "ru", "русский": "ru",
    "ja": "ja", "jpn": "ja", "japanese": "ja", "日本語": "ja",
}
#: Labelled documents of each language from which the network is trained, at most: distinct texts, the first by hash.
SAMPLE = 120
#: Characters that such a document may have; others are judged, but not learned from.
SAMPLE_CHARS = (40, 20_000)
#: Bytes of a window, entries of an embedding, filter widths and filters of each width.
WINDOW, EMBED, WIDTHS, FILTERS = 96, 8, (2, 3, 4, 5), 32
#: Passes over the training windows.
EPOCHS = 7
#: Log-odds that a change of language inside a text must win, and the most that one sentence may count.
CHANGE, MOST = 1.6, 14.0
#: Different words from which a sentence counts fully.
FULL = 6.0
#: Texts judged at once, and windows of one product (few, so that they stay in the cache).
TEXTS, PRODUCT = 256, 16


def label_language(label: Column) -> Column:
    """The language that a label names by code, name or region; null if none of LANGS."""
    base = F.regexp_extract(F.lower(F.trim(label)), r"^(?U)(\p{L}+)", 1)
    names = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return names[base]


#: Private signs that stand between sentences and between texts while many are handled as one string.
CUT, END = "\ue000", "\ue001"
_LATIN_END = re.compile(r"([.!?…]['\"»”’)\]]*\s)")
_CJK_END = re.compile(r"([。！？][』」”)）]*)(?![。！？』」”)）])")
_LINE_END = re.compile(r"[\r\n]+")
_HYPHEN = re.compile(r"(?<=[^\W\d_])-\r?\n(?=[^\W\d_])")
_CODE = re.compile(r"[=_@\d](?:(?<=[=_@])|(?<=[a-z]\d))")
_REPEATED = re.compile(r"([^\w\s\ue000\ue001]|_)\1+")
_CJK = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]")
_DIGIT = re.compile(r"\d")
#: Letters that one word may have; longer runs are no words.
WORD = 24


def _marked(text: str) -> str:
    """A text (or many, with END between them) with CUT after each whole sentence."""
    if "-\n" in text or "-\r\n" in text:
        text = _HYPHEN.sub("", text)
    text = _LATIN_END.sub(r"\1" + CUT, text)
    if "。" in text or "！" in text or "？" in text:
        text = _CJK_END.sub(r"\1" + CUT, text)
    return _LINE_END.sub(CUT, text).replace(" / ", CUT)


def sentences(text: str) -> list[str]:
    """Whole sentences: up to an end mark with its closing quotes, or to a line's end; hyphenated line ends go on."""
    return [s for s in _marked(text.replace(CUT, " ").replace(END, " ")).split(CUT) if s and not s.isspace()]


def _without_codes(text: str) -> str:
    """A blank for each run of ASCII signs that holds =, _, @ or a digit behind a letter."""
    out, upto = [], 0
    for m in _CODE.finditer(text):
        a, b = m.start(), m.end()
        if a < upto:
            continue
        while a > upto and "!" <= text[a - 1] <= "~":
            a -= 1
        while b < len(text) and "!" <= text[b] <= "~":
            b += 1
        out.append(text[upto:a])
        upto = b
    return " ".join([*out, text[upto:]])


def _cleaned(text: str) -> str:
    """What the network sees of sentences, blanks aside: lower case, composed, without codes and digits, repeated signs once."""
    text = _without_codes(unicodedata.normalize("NFC", text).lower())
    for sign in "0123456789*#":
        text = text.replace(sign, " ")
    return _REPEATED.sub(r"\1", text if text.isascii() else _DIGIT.sub(" ", text))


def prepare(sentence: str) -> bytes:
    """A sentence as the network sees it."""
    return " ".join(_cleaned(sentence).split()).encode("utf-8", "ignore")


def words(tokens: list[str]) -> float:
    """About how many different words a sentence of such tokens has; scripts written without spaces count by signs."""
    kinds = set(tokens)
    found = sum(map(str.islower, kinds))  # tokens with a cased letter
    if found and max(map(len, kinds)) > WORD:
        found = sum(t.islower() and len(t) <= WORD for t in kinds)
    if found < FULL and not (joined := " ".join(kinds)).isascii():
        found += len(set(_CJK.findall(joined))) / 3
    return found


def spans(length: int) -> list[tuple[int, int]]:
    """All of so many bytes in fixed-length windows; they share the bytes evenly, so none is very short."""
    n = max(1, -(-length // WINDOW))
    step = length / n
    return [(int(k * step), int((k + 1) * step)) for k in range(n)]


def windows(data: bytes) -> list[bytes]:
    return [data[a:b] for a, b in spans(len(data))]


def matrix(parts: list[bytes]) -> np.ndarray:
    """One window a row, zeros after its bytes; zeros are seen as nothing, however many follow."""
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    out = np.zeros((len(parts), WINDOW), np.uint8)
    out[np.arange(WINDOW) < size[:, None]] = np.frombuffer(b"".join(parts), np.uint8)
    return out


def new_network(rng: np.random.Generator) -> dict[str, np.ndarray]:
    w = {"e": rng.standard_normal((256, EMBED)) * 0.5}
    for k in WIDTHS:
        w[f"k{k}"] = rng.standard_normal((k * EMBED, FILTERS)) * math.sqrt(2 / (k * EMBED))
        w[f"b{k}"] = np.zeros(FILTERS)
    w["o"] = rng.standard_normal((FILTERS * len(WIDTHS), len(LANGS))) * 0.1
    w["c"] = np.zeros(len(LANGS))
    return {k: v.astype(np.float32) for k, v in w.items()}


def _filters(w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The embedding, in which zero bytes are nothing, all filters as columns over the widest window (narrower ones are
    zero behind their width), and their biases."""
    out = np.zeros((max(WIDTHS) * EMBED, FILTERS * len(WIDTHS)), np.float32)
    for j, k in enumerate(WIDTHS):
        out[: k * EMBED, j * FILTERS : (j + 1) * FILTERS] = w[f"k{k}"]
    e = w["e"].copy()
    e[0] = 0
    return e, out, np.concatenate([w[f"b{k}"] for k in WIDTHS])


def forward(w: dict[str, np.ndarray], bytes_: np.ndarray, keep: bool = False, ready=None):
    """Log-probabilities of each window: embedding, one product for the filters of all widths, maximum, softmax.

    Behind the bytes stands room for the widest filter and one more, so a window's result does not depend on how many
    zeros follow it.
    """
    n, length = bytes_.shape
    widest = max(WIDTHS)
    e, filters, bias = ready or _filters(w)
    x = np.zeros((n, length + widest, EMBED), np.float32)
    x[:, :length] = e[bytes_]
    s = x.strides
    c = np.lib.stride_tricks.as_strided(x, (n, length + 1, widest * EMBED), s).reshape(-1, widest * EMBED)
    y = (c @ filters).reshape(n, length + 1, -1)
    best = y.max(1)
    top = ((y == best[:, None]) * np.arange(length + 1, dtype=np.uint8)[:, None]).max(1) if keep else None
    y = best
    f = np.maximum(y + bias, 0)
    z = f @ w["o"] + w["c"]
    z -= z.max(1, keepdims=True)
    logp = z - np.log(np.exp(z).sum(1, keepdims=True))
    return (logp, f, top, c) if keep else logp


def _sizes(bytes_: np.ndarray) -> np.ndarray:
    """How many bytes each window has."""
    return bytes_.shape[1] - (bytes_[:, ::-1] != 0).argmax(1) if len(bytes_) else np.zeros(0, int)


def predict(w: dict[str, np.ndarray], bytes_: np.ndarray) -> np.ndarray:
    """Log-probabilities of each window, in products of windows of about one length."""
    out, ready = np.zeros((len(bytes_), len(LANGS)), np.float32), _filters(w)
    size = _sizes(bytes_)
    order = np.argsort(size, kind="stable")
    for a in range(0, len(order), PRODUCT):
        i = order[a : a + PRODUCT]
        out[i] = forward(w, bytes_[i, : size[i[-1]]], ready=ready)
    return out


def train(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.004, w=None) -> dict[str, np.ndarray]:
    """Adam on the cross entropy with a little label smoothing."""
    w = w or new_network(rng)
    m, v, t = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}, 0
    steps, size = max(1, epochs * math.ceil(len(x) / batch)), _sizes(x)
    for _ in range(epochs):
        # Batches of windows of about one length, in a random order.
        order = rng.permutation(len(x))
        order = np.concatenate([o[np.argsort(size[o], kind="stable")] for o in (order[a : a + 16 * batch] for a in range(0, len(x), 16 * batch))])
        for a in rng.permutation(range(0, len(x), batch)):
            i = order[a : a + batch]
            bx = x[i, : max(8, size[i].max())]
            logp, f, top, c = forward(w, bx, True)
            want = np.full(logp.shape, 0.01 / len(LANGS), np.float32)
            want[np.arange(len(i)), y[i]] += 0.99
            dz = (np.exp(logp) - want) / len(i)
            g = {"o": f.T @ dz, "c": dz.sum(0)}
            df = dz @ w["o"].T * (f > 0)
            de = np.zeros((256, EMBED))
            seen = c[np.arange(len(i))[:, None] * (bx.shape[1] + 1) + top.astype(int)].transpose(1, 0, 2)  # filter, window, inputs
            dk = (df.T[:, None, :] @ seen)[:, 0].T
            padded = np.pad(bx, ((0, 0), (0, max(WIDTHS))))
            for j, k in enumerate(WIDTHS):
                own = slice(j * FILTERS, (j + 1) * FILTERS)
                g[f"k{k}"], g[f"b{k}"] = dk[: k * EMBED, own], df[:, own].sum(0)
                back = (df[:, own, None] * w[f"k{k}"].T[None]).reshape(-1, EMBED)
                at = padded[np.arange(len(i))[:, None, None], top[:, own, None].astype(int) + np.arange(k)].ravel()
                for q in range(EMBED):
                    de[:, q] += np.bincount(at, back[:, q], 256)
            de[0] = 0
            g["e"] = de
            t += 1
            lr = rate * (1 - t / (steps + 1))
            for k, gk in g.items():
                m[k] = 0.9 * m[k] + 0.1 * gk
                v[k] = 0.999 * v[k] + 0.001 * gk * gk
                w[k] = (w[k] - lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return w


def fit(labelled: list[tuple[str, str]], seed: int = 11) -> dict[str, np.ndarray]:
    """Trains on (text, language); sentences that a first network firmly gives to another language are left out of the second."""
    rng = np.random.default_rng(seed)
    parts, y = [], []
    for text, lang in labelled:
        for s in sentences(text):
            data = prepare(s)
            if len(data) >= 12:
                # Every third sentence is learned without its accents, as careless writers leave them out.
                bare = data.decode("utf-8") if len(y) % 3 == 0 and lang not in ("ja", "ru") else ""
                bare = "".join(c for c in unicodedata.normalize("NFD", bare) if not unicodedata.combining(c)).encode()
                for p in windows(bare or data):
                    parts.append(p)
                    y.append(LANGS.index(lang))
    if not parts:
        return new_network(rng)
    x, y = matrix(parts), np.array(y)
    w = train(x, y, rng, 2)
    p = predict(w, x)
    sure = (p.argmax(1) == y) | (p.max(1) < math.log(0.6))
    x, y = x[sure], y[sure]
    # Short windows too: halves of some windows teach the network to judge little text.
    cut_ = np.where(np.arange(WINDOW)[None] < rng.integers(16, 48, len(x))[:, None], x, 0)
    pick = rng.random(len(x)) < 0.3
    return train(np.concatenate([x, cut_[pick]]), np.concatenate([y, y[pick]]), rng, EPOCHS)


def _confidence(scores: np.ndarray, lang: int) -> float:
    z = scores.sum(0)
    z = np.exp(z - z.max())
    return float(z[lang] / z.sum())


def segments(scores: np.ndarray, change: float = CHANGE) -> list[tuple[int, int, int, float]]:
    """(first sentence, sentences, language, confidence) of the best path over sentence scores (log-probabilities)."""
    n, k = scores.shape
    total, back = scores[0].copy(), np.zeros((n, k), int)
    for i in range(1, n):
        best = int(total.argmax())
        go = total[best] - change
        back[i] = np.where(total >= go, np.arange(k), best)
        total = np.maximum(total, go) + scores[i]
    path = [int(total.argmax())]
    for i in range(n - 1, 0, -1):
        path.append(int(back[i, path[-1]]))
    path.reverse()
    out, a = [], 0
    for i in range(1, n + 1):
        if i == n or path[i] != path[a]:
            out.append((a, i - a, path[a], _confidence(scores[a:i], path[a])))
            a = i
    return out


def _detector(shared):
    def run(batches):
        w = shared.value
        for pdf in batches:
            for a in range(0, len(pdf), TEXTS):
                yield detect(w, pdf["id"].iloc[a : a + TEXTS].tolist(), pdf["text"].iloc[a : a + TEXTS].tolist())

    return run


def detect(w: dict[str, np.ndarray], ids: list, texts: list) -> pd.DataFrame:
    """The segments of some texts. A sentence's score is the sum over its windows; few different words count less, and
    no sentence counts without bound."""
    whole = END.join((t or "").replace(CUT, " ").replace(END, " ") for t in texts)
    doc, parts, count, known = [], [], [], []
    for k, text in enumerate(_cleaned(_marked(whole)).split(END)):
        for raw in text.split(CUT):
            tokens = raw.split()
            if n := words(tokens):
                data = " ".join(tokens).encode("utf-8", "ignore")
                mine = [data] if len(data) <= WINDOW else windows(data)
                doc.append(k)
                parts += mine
                count.append(len(mine))
                known.append(n)
    out = {c: [] for c in ("id", "seg_no", "lang", "confidence", "n_sentences", "n_segments")}
    if doc:
        doc, count = np.array(doc), np.array(count)
        scores = np.add.reduceat(predict(w, matrix(parts)).astype(float), np.r_[0, np.cumsum(count)[:-1]])
        weight = np.minimum(1.0, (np.array(known) / FULL) ** 2)[:, None]
        scores = np.maximum((scores - scores.max(1, keepdims=True)) * weight, -MOST)
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        best = scores.argmax(1)
        one = np.minimum.reduceat(best, first) == np.maximum.reduceat(best, first)
        for a, b, alike in zip(first, np.r_[first[1:], len(doc)], one):
            # Where every sentence is likeliest in one language, so is the path; else it is searched.
            path = [(0, b - a, int(best[a]), _confidence(scores[a:b], best[a]))] if alike else segments(scores[a:b])
            for no, (_, n, lang, sure) in enumerate(path, 1):
                for c, x in zip(out, (ids[doc[a]], no, LANGS[lang], sure, n, len(path))):
                    out[c].append(x)
    return pd.DataFrame(out).astype({"lang": object, "seg_no": "int32", "n_sentences": "int32", "n_segments": "int32", "confidence": float})


def train_on(docs: DataFrame, text: str, label: str, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """The network, trained in one task on at most `sample` distinct labelled texts of each language, the first by hash.

    Labels are only hints: sentences that a first network firmly gives to another language are not learned. A sampled
    text is judged like any other, so its own label has had a small part in the network.
    """
    named = docs.select(col(text).cast("string").alias("text"), label_language(col(label).cast("string")).alias("lang")).filter("lang is not null")
    named = named.filter(F.length("text").between(*SAMPLE_CHARS)).withColumn("h", F.xxhash64("text"))
    # From the number of texts of a language follows a bound on the hash that about four times the sample stay below, so
    # the rows that reach the last task depend on neither the number of tasks nor that of documents.
    many = {r["lang"]: r["n"] for r in named.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}  # one row a language
    if not many:
        return new_network(np.random.default_rng(11))
    below = F.create_map(*[F.lit(x) for x in sum(((lang, -(2.0**63) + 2.0**64 * min(1.0, 4 * sample / max(n, 1))) for lang, n in many.items()), ())])
    near = named.filter(F.col("h") <= below[F.col("lang")]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    first = near.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h"))).filter(F.col("r") <= sample)

    def run(batches):
        held = [x for pdf in batches for x in zip(pdf["text"], pdf["lang"])]
        yield pd.DataFrame({"model": [pickle.dumps(fit(sorted(held)))]})

    got = first.select("text", "lang").coalesce(1).mapInPandas(run, "model binary").collect()  # the bounded model, some 50 kB
    return pickle.loads(bytes(got[0]["model"])) if got else new_network(np.random.default_rng(11))


def language_segments(docs: DataFrame, doc_id: str, text: str, label: str, model: dict[str, np.ndarray] | None = None) -> DataFrame:
    """doc_id, seg_no, lang, confidence, n_sentences, n_segments and label_lang: the segments of every text with words, from 1 in reading order.

    Whole texts are read. Null, empty and wordless texts give no row; a text in one language gives one segment. The
    label is not asked when its own text is judged; label_lang is the language that it names, or null. Without a given model
    the network is trained on a bounded sample of the labelled rows; without labelled rows it is untrained, and every
    language is a guess with the low confidence that it has. An empty table gives no row; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or train_on(docs, text, label))
    rows = spread(docs.select(col(doc_id).alias("id"), col(text).cast("string").alias("text"), label_language(col(label).cast("string")).alias("label_lang")))
    kind = dict(rows.dtypes)["id"]
    scan = _detector(shared)

    def run(batches):
        for pdf in batches:
            ids, named = pdf["id"].to_numpy(), pdf["label_lang"].to_numpy()
            for got in scan(iter([pdf.assign(id=range(len(pdf)))])):
                at = got["id"].to_numpy(int)
                yield got.assign(id=ids[at], label_lang=named[at])

    found = rows.filter("text is not null").mapInPandas(run, f"id {kind}, seg_no int, lang string, confidence double, n_sentences int, n_segments int, label_lang string")
    return found.withColumnRenamed("id", doc_id)


def relabelled(found: DataFrame, doc_id: str) -> DataFrame:
    """doc_id, seg_no, lang: the segments of mixed texts, and the only one of a text whose label names no or another language."""
    wrong = (F.col("n_segments") > 1) | F.col("label_lang").isNull() | (F.col("label_lang") != F.col("lang"))
    return found.filter(wrong).select(doc_id, "seg_no", "lang")
