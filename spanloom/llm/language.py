"""Languages of texts, by a byte convolutional network trained here on labelled rows.

The network reads UTF-8 bytes: filters of several widths, of which each is a table of 256 weights per place, a
rectifier, the largest value over a window, and a softmax over the languages. It is trained in numpy on a bounded
sample of labelled documents and applied to windows of a fixed number of bytes, all windows of every text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.session import materialize

#: The languages, and other ways to write their codes.
LANGUAGES = "en de fr es it pt ru ja zh yue ko".split()
CODES = {"eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "ita": "it", "por": "pt", "rus": "ru", "jpn": "ja", "zho": "zh", "chi": "zh", "cmn": "zh", "kor": "ko"}
MISSING = ("", "und", "auto")

#: Filter widths in bytes, and filters of each width.
WIDTHS, FILTERS = (2, 3, 4, 6), 20
#: Bytes of a window.
WINDOW = 192
#: Labelled documents per language that are used for training, and stretches taken from each.
TRAIN_DOCS, TRAIN_CUTS = 240, 10
#: Stretches of a training document, of so many characters each and from anywhere in it, that the driver gets at most.
TRAIN_PARTS, TRAIN_CHARS = 10, 2000
#: Owners of each label whose lines are used for training too, and lines taken from each.
TRAIN_OWNERS, TRAIN_LINES = 60, 40
EPOCHS, BATCH, SEED = 12, 256, 7
_PAD = max(WIDTHS) - 1
_LETTERS = re.compile(r"[^\W\d_]")
_MARKS = re.compile(r"[^\w\s]+")


def code_of(label: Column) -> Column:
    """One of the codes above in whatever case, with a region or in three letters; null if missing; else as it is."""
    low = F.lower(F.trim(label))
    base = F.when(low.rlike("^(zh|zho|chi)[-_]yue"), F.lit("yue")).otherwise(F.substring_index(F.substring_index(low, "-", 1), "_", 1))
    base = F.coalesce(F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])[base], base)
    return F.when(low.isin(*MISSING), F.lit(None)).otherwise(base)


class Network:
    """Weights: per width a table (width, 256, FILTERS) and biases, then a dense layer."""

    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.tables = [rng.normal(0, 0.3 / w**0.5, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        n = FILTERS * len(WIDTHS)
        self.dense = rng.normal(0, 1 / n**0.5, (n, len(LANGUAGES))).astype(np.float32)
        self.out = np.zeros(len(LANGUAGES), np.float32)

    @staticmethod
    def stream(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The windows one after another with zeros between, and where each starts."""
        gap = b"\0" * _PAD
        x = np.frombuffer(gap.join(windows) + gap, np.uint8)
        sizes = np.fromiter(map(len, windows), np.int64, len(windows)) + _PAD
        return x, np.concatenate([[0], np.cumsum(sizes)[:-1]])

    def _conv(self, x: np.ndarray, k: int) -> np.ndarray:
        m = len(x) - _PAD
        t = self.tables[k]
        acc = t[0].take(x[:m], axis=0)
        for i in range(1, len(t)):
            acc += t[i].take(x[i : m + i], axis=0)
        return acc

    def pooled(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.concatenate([np.maximum(np.maximum.reduceat(self._conv(x, k), starts, axis=0) + self.bias[k], 0) for k in range(len(WIDTHS))], axis=1)

    def predict(self, windows: list[bytes]) -> np.ndarray:
        """Probabilities (windows, languages)."""
        out, at = [], 0
        while at < len(windows):
            to, size = at, 0
            while to < len(windows) and size < 16_000:
                size += len(windows[to]) + _PAD
                to += 1
            x, starts = self.stream(windows[at:to])
            z = self.pooled(x, starts) @ self.dense + self.out
            z = np.exp(z - z.max(1, keepdims=True))
            out.append(z / z.sum(1, keepdims=True))
            at = to
        return np.concatenate(out) if out else np.zeros((0, len(LANGUAGES)), np.float32)

    def step(self, windows: list[bytes], y: np.ndarray, lr: float, state: dict) -> None:
        """One step of Adam on the cross entropy with slightly softened labels."""
        x, starts = self.stream(windows)
        n, feats, where = len(windows), [], []
        segment = np.repeat(np.arange(n), np.diff(np.append(starts, len(x) - _PAD)))
        for k in range(len(WIDTHS)):
            acc = self._conv(x, k)
            top = np.maximum.reduceat(acc, starts, axis=0)
            # the place of each window's largest value: the first of equals
            hit = np.flatnonzero((acc == top[segment]).ravel())
            cell = segment[hit // FILTERS] * FILTERS + hit % FILTERS
            place = np.zeros(n * FILTERS, np.int64)
            place[cell[::-1]] = hit[::-1] // FILTERS
            where.append(place.reshape(n, FILTERS))
            feats.append(top + self.bias[k])
        raw = np.concatenate(feats, axis=1)
        act = np.maximum(raw, 0)
        z = act @ self.dense + self.out
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        want = np.full_like(p, 0.02 / len(LANGUAGES))
        want[np.arange(n), y] += 0.98
        dz = (p - want) / n
        grads = {"dense": act.T @ dz, "out": dz.sum(0)}
        da = (dz @ self.dense.T) * (raw > 0)
        for k, w in enumerate(WIDTHS):
            d = da[:, k * FILTERS : (k + 1) * FILTERS]
            grads[f"b{k}"] = d.sum(0)
            g = np.zeros(w * 256 * FILTERS, np.float32)
            column = np.arange(FILTERS)
            for i in range(w):
                g += np.bincount(((i * 256 + x[where[k] + i].astype(np.int64)) * FILTERS + column).ravel(), weights=d.ravel(), minlength=len(g)).astype(np.float32)
            grads[f"t{k}"] = g.reshape(w, 256, FILTERS)
        state["n"] = state.get("n", 0) + 1
        for name, g in grads.items():
            v = self.tables[int(name[1:])] if name[0] == "t" else self.bias[int(name[1:])] if name[0] == "b" else getattr(self, name)
            m, s = state.setdefault(name, (np.zeros_like(v), np.zeros_like(v)))
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v -= lr * (m / (1 - 0.9 ** state["n"])) / (np.sqrt(s / (1 - 0.99 ** state["n"])) + 1e-7)


def windows_of(text: str, size: int = WINDOW) -> list[bytes]:
    """All of the text in windows of ``size`` bytes, the last as long as what is left."""
    b = text.encode("utf-8", "replace")
    return [b[i : i + size] for i in range(0, len(b), size)]


def _letters(windows: list[bytes]) -> np.ndarray:
    """Letter bytes of each window, about: what is not ASCII, or an ASCII letter."""
    return np.array([len(_ASCII_OTHER.sub(b"", w)) for w in windows], np.float32)


_ASCII_OTHER = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+")


def text_probabilities(net: Network, texts: list[str], letters: bool = False) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """Per text the mean over its windows, weighted by their letters; zeros where a text has no letter. With ``letters``, these too."""
    parts, owner = [], []
    for i, t in enumerate(texts):
        w = windows_of(t)
        parts += w
        owner += [i] * len(w)
    out = np.zeros((len(texts), len(LANGUAGES)), np.float64)
    weight = np.zeros(len(texts))
    if parts:
        n = _letters(parts)
        np.add.at(out, owner, net.predict(parts) * n[:, None])
        np.add.at(weight, owner, n)
    p = out / np.maximum(weight, 1e-9)[:, None]
    return (p, weight) if letters else p


def cuts(text: str, rng: np.random.Generator, n: int = TRAIN_CUTS) -> list[bytes]:
    """Stretches of a text for training: windows, and single lines or sentences as short as those to be told."""
    out = []
    b = text.encode("utf-8", "replace")
    pieces = [p for p in re.split(r"\n+|(?<=[.!?])\s+|(?<=[。！？])", text) if len(_LETTERS.findall(p)) >= 4]
    for i in range(n):
        if i % 3 == 0 or not pieces:
            at = int(rng.integers(0, max(1, len(b) - WINDOW)))
            w = b[at : at + int(rng.integers(48, WINDOW + 1))]
        else:
            w = pieces[int(rng.integers(len(pieces)))].encode("utf-8", "replace")[:WINDOW]
            if i % 6 == 5 and len(w) > 24:
                at = int(rng.integers(0, len(w) - 20))
                w = w[at : at + int(rng.integers(18, 60))]
        if len(_ASCII_OTHER.sub(b"", w)) >= 4:
            out.append(w)
            if i % 4 == 1:  # as people also write: all in large letters, or in small ones without marks
                t = w.decode("utf-8", "ignore")
                out.append((t.upper() if i % 8 == 1 else _MARKS.sub("", t).lower()).encode())
    return out


def train(labelled: list[tuple[str, str]], epochs: int = EPOCHS, seed: int = SEED, lines: list[tuple[str, str, str]] = ()) -> Network:
    """Fit on (text, code) pairs; then what the network rejects is dropped and the fit is repeated.

    ``lines`` are (owner, text, code), short texts whose owner has a label. They come in with the second fit, if the
    network tells most of an owner's lines as its label does; of these lines only those are left out that are long and
    clearly in another language.
    """
    known = [(t, LANGUAGES.index(c)) for t, c in labelled if c in LANGUAGES and t]
    net = Network(seed)
    short: list[tuple[bytes, int]] = []
    for again in (False, True):
        if again:
            p = text_probabilities(net, [t for t, _ in known])
            known = [x for x, row in zip(known, p) if row.argmax() == x[1]]
            short = _short(net, lines)
            net = Network(seed)
        rng = np.random.default_rng(seed)
        data = [(w, y) for t, y in known for w in cuts(t, rng)] + short
        # every language as often: a rare one is drawn again
        of = [[i for i, (_, y) in enumerate(data) if y == k] for k in range(len(LANGUAGES))]
        most = min(max(map(len, of), default=0), TRAIN_DOCS * TRAIN_CUTS)
        state: dict = {}
        rounds = epochs if again else max(3, epochs // 2)
        for e in range(rounds):
            order = np.concatenate([rng.choice(o, min(most, max(len(o), 400)), replace=len(o) < 400) for o in of if o]) if data else np.zeros(0, int)
            rng.shuffle(order)
            for i in range(0, len(order), BATCH):
                part = [data[int(j)] for j in order[i : i + BATCH]]
                net.step([w for w, _ in part], np.array([y for _, y in part]), 0.012 * (1 - e / rounds) + 0.0005, state)
    return net


def _short(net: Network, lines: list[tuple[str, str, str]]) -> list[tuple[bytes, int]]:
    out: list[tuple[bytes, int]] = []
    by: dict[tuple[str, int], list[str]] = {}
    for owner, text, code in lines:
        if code in LANGUAGES and _LETTERS.search(text):
            by.setdefault((owner, LANGUAGES.index(code)), []).append(text)
    for (_, y), texts in sorted(by.items()):
        p = text_probabilities(net, texts)
        if np.bincount(p.argmax(1), minlength=len(LANGUAGES)).argmax() == y:
            for t, row in zip(texts, p):
                w = t.encode("utf-8", "replace")[:WINDOW]
                if row[y] >= 0.05 or len(_ASCII_OTHER.sub(b"", w)) < 40:
                    out.append((w, y))
    return out


_DONE: dict[str, Network] = {}


def fitted(docs: DataFrame, lines: DataFrame | None = None, labels: DataFrame | None = None, per_language: int = TRAIN_DOCS) -> Network:
    """A network fitted on at most ``per_language`` labelled documents of each language, chosen by the hash of their id.

    With ``lines`` (owner, id, text) and ``labels`` (owner, lang), also on ``TRAIN_LINES`` lines of ``TRAIN_OWNERS`` owners
    of each label, see :func:`train`. A sample that was fitted before in this process is not fitted again.
    """
    x = docs.select("doc_id", code_of(F.col("lang")).alias("code"), F.length("text").alias("n")).where(F.col("code").isin(*LANGUAGES) & (F.col("n") >= 40))
    w = Window.partitionBy("code").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = x.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_language).groupBy("doc_id").agg(F.min("code").alias("code"))
    # stretches spread evenly over the whole text, all of it if it is short
    n = F.length("text")
    part = lambda i: F.substring(F.col("text"), (F.floor((n - TRAIN_CHARS) * i / (TRAIN_PARTS - 1)) + 1).cast("int"), F.lit(TRAIN_CHARS))
    sample = F.when(n <= TRAIN_PARTS * TRAIN_CHARS, F.col("text")).otherwise(F.concat_ws("\n", *[part(i) for i in range(TRAIN_PARTS)]))
    # at most per_language ids of each language: few enough to go to every task, so that no text is moved for them
    rows = docs.select("doc_id", sample.alias("text")).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "code").agg(F.min("text").alias("text")).select("text", "code").collect()
    sample = sorted((r.text, r.code) for r in rows), _lines(lines, labels) if lines is not None and labels is not None else []
    name = hashlib.sha256(repr(sample).encode("utf-8", "replace")).hexdigest()
    if name not in _DONE:
        while len(_DONE) > 3:
            _DONE.pop(next(iter(_DONE)))
        _DONE[name] = train(sample[0], lines=sample[1])
    return _DONE[name]


def _lines(lines: DataFrame, labels: DataFrame) -> list[tuple[str, str, str]]:
    """(owner, text, code) of a bounded sample of lines, by the hash of owner and id."""
    n = labels.select("owner", code_of(F.col("lang")).alias("code")).where(F.col("code").isin(*LANGUAGES) & F.col("owner").isNotNull()).groupBy("owner", "code").agg(F.count(F.lit(1)).alias("n"))
    owners = n.groupBy("owner").agg(F.max_by("code", F.struct("n", "code")).alias("code"))
    w = Window.partitionBy("code").orderBy(F.xxhash64("owner"), "owner")
    # TRAIN_OWNERS of each language at most, so they go to every task
    owners = owners.withColumn("r", F.row_number().over(w)).where(F.col("r") <= TRAIN_OWNERS).drop("r")
    v = Window.partitionBy("owner").orderBy(F.xxhash64("id"), "id", "text")
    x = lines.select("owner", "id", "text").where("id is not null and text is not null").join(F.broadcast(owners), "owner").withColumn("r", F.row_number().over(v)).where(F.col("r") <= TRAIN_LINES)
    return sorted((r.owner, r.text, r.code) for r in x.collect())


def _classify(net: Network, keys: list[str]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(LANGUAGES)
        for b in batches:
            p, n = text_probabilities(net, [t or "" for t in b["text"].to_pylist()], True)
            keep = np.flatnonzero(n > 0)
            p, best = p[keep].astype(np.float32), p[keep].argmax(1)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), len(LANGUAGES)).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays(
                [*[b[k].take(pa.array(keep)) for k in keys], pa.array(names[best], pa.string()), pa.array(p[np.arange(len(p)), best]), lists, pa.array(n[keep].astype(np.int64))],
                [*keys, "lang", "confidence", "chances", "letters"],
            )

    return run


def languages(df: DataFrame, net: Network, keys: list[str]) -> DataFrame:
    """The columns ``keys`` with lang, confidence, the chances of all languages and the letters of each row's ``text``.

    Rows whose text is null, empty or without a letter have no language and are left out; other rows are kept as often
    as they stand. All windows of a text count, however long it is.
    """
    x = df.select(*keys, "text").where("text is not null")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.select(*keys).schema)
    return x.mapInArrow(_classify(net, keys), f"{schema}, lang string, confidence float, chances array<float>, letters long")


#: What a change of language costs, as the logarithm of odds: so much evidence a stretch needs at either end.
SWITCH = 2.5
#: Letter bytes from which a text's evidence counts in full; less counts in proportion.
FULL_LETTERS = 30
#: Evidence from which a text shows that another language may be near.
SHOWN = SWITCH
#: Length of a chunk of an owner's time line, and how far lines around it are looked at, in milliseconds.
CHUNK_MS, AROUND_MS = 600_000, 60_000


def path(evidence: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The likeliest sequence of states, column 0 the usual one, where each change costs ``switch``, at the ends too if not usual."""
    n, k = evidence.shape
    back = np.empty((n, k), np.int64)
    start = np.full(k, -switch)
    start[0] = 0
    score = start + evidence[0]
    for i in range(1, n):
        best = int(score.argmax())
        stay = score >= score[best] - switch
        back[i] = np.where(stay, np.arange(k), best)
        score = np.where(stay, score, score[best] - switch) + evidence[i]
    out = np.empty(n, np.int64)
    out[-1] = int((score + start).argmax())
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def _odds(p: np.ndarray, letters: np.ndarray, main: int) -> tuple[np.ndarray, list[int]]:
    """Evidence for the usual language and for each other one that some row shows; and which these are."""
    e = np.log(np.maximum(p, 1e-6))
    e = (e - e[:, [main]]) * np.minimum(1, letters / FULL_LETTERS)[:, None]
    shown = [k for k in np.flatnonzero((e >= SHOWN).any(0)).tolist() if k != main]
    return e[:, [main, *shown]], [main, *shown]


def of_owners(lines: DataFrame) -> DataFrame:
    """(owner, main, share) from classified lines: the language of most lines, each counted by its confidence."""
    votes = lines.groupBy("owner", "lang").agg(F.sum("confidence").alias("votes"))
    return votes.groupBy("owner").agg(F.max_by("lang", F.struct("votes", "lang")).alias("main"), (F.max("votes") / F.sum("votes")).alias("share"))


def _foreign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rest: pa.Table | None = None
    code = {x: i for i, x in enumerate(LANGUAGES)}

    def done(t: pa.Table) -> pa.RecordBatch:
        ids, mine = t["id"].to_pylist(), t["mine"].to_numpy()
        once = np.array([True, *(x != y for x, y in zip(ids, ids[1:]))])  # delivered twice: neighbours in the order
        at = np.flatnonzero(once)
        p = np.array(t["chances"].take(pa.array(at)).to_pylist(), np.float64)
        e, states = _odds(p, t["letters"].to_numpy()[at], code[t["main"][0].as_py()])
        way = path(e)
        hit = np.flatnonzero((way > 0) & mine[at])
        lang = np.array(states)[way[hit]]
        return pa.RecordBatch.from_arrays([t["owner"].take(pa.array(at[hit])).combine_chunks().cast(pa.string()), pa.array([ids[i] for i in at[hit]], pa.string()), pa.array([LANGUAGES[k] for k in lang], pa.string()), pa.array(p[hit, lang].astype(np.float32))], ["owner", "id", "lang", "confidence"])

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        owner, chunk = t["owner"].to_numpy(), t["chunk"].to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (chunk[1:] != chunk[:-1])])).tolist()
        for lo, hi in zip(cut, cut[1:]):
            yield done(t.slice(lo, hi - lo))
        rest = t.slice(cut[-1]).combine_chunks()
    if rest is not None and rest.num_rows:
        yield done(rest)


def foreign(lines: DataFrame, owners: DataFrame, chunk_ms: int = CHUNK_MS, around_ms: int = AROUND_MS) -> DataFrame:
    """Lines in another language than their owner's: (owner, id, lang, confidence), the network's chance of that language.

    Lines are judged in order, together: the likeliest sequence of languages in which each change costs ``SWITCH``. So a
    short line is told by its neighbours, and a single odd line, such as one with a name, is none. Every line with a letter
    is judged. An owner's time line is cut into chunks, with the lines ``around_ms`` on either side looked at too; chunks
    near no line that shows another language (``SHOWN``) are left out.
    """
    x = lines.join(owners.select("owner", "main"), "owner").withColumn("at", F.coalesce("start_ms", "end_ms", F.lit(0).cast("long")))
    near = F.sequence(F.floor((F.col("at") - around_ms) / chunk_ms), F.floor((F.col("at") + around_ms) / chunk_ms))
    own = F.element_at("chances", F.array_position(F.array(*map(F.lit, LANGUAGES)), F.col("main")).cast("int"))
    evidence = F.log(F.col("confidence") / F.greatest(own, F.lit(1e-6))) * F.least(F.lit(1.0), F.col("letters") / FULL_LETTERS)
    active = x.where((F.col("lang") != F.col("main")) & (evidence >= SHOWN)).select("owner", F.explode(near).alias("chunk")).distinct()
    spread = x.select("owner", "id", "at", "end_ms", "main", "chances", "letters", F.floor(F.col("at") / chunk_ms).alias("own"), F.explode(near).alias("chunk")).join(active, ["owner", "chunk"], "left_semi")
    spread = spread.select("owner", "chunk", "at", "end_ms", "id", "main", "chances", "letters", (F.col("own") == F.col("chunk")).alias("mine"))
    return spread.repartition("owner", "chunk").sortWithinPartitions("owner", "chunk", "at", "end_ms", "id").mapInArrow(_foreign, "owner string, id string, lang string, confidence float")


#: Foreign lines of one language that begin within this time of the last one's start are one stretch.
STRETCH_MS = 30_000


def stretches(found: DataFrame, cues: DataFrame, owner: Column, within_ms: int = STRETCH_MS) -> DataFrame:
    """Foreign stretches: (owner, lang, first_id, last_id, lines, start_ms, end_ms, confidence), the mean of its lines'.

    ``found`` comes from :func:`foreign`; only foreign lines are put in order, so a long owner is no large task. An
    unknown or impossible end counts as the start.
    """
    t = cues.select(owner.alias("owner"), "id", "start_ms", F.greatest("start_ms", F.coalesce("end_ms", "start_ms")).alias("end_ms")).where("start_ms is not null").dropDuplicates(["owner", "id"])
    x = found.dropDuplicates(["owner", "id"]).join(t, ["owner", "id"])
    w = Window.partitionBy("owner", "lang").orderBy("start_ms", "id")
    x = x.withColumn("new", F.coalesce((F.col("start_ms") - F.lag("start_ms").over(w) > within_ms).cast("int"), F.lit(1))).withColumn("part", F.sum("new").over(w))
    at = F.struct("start_ms", "id")
    return x.groupBy("owner", "lang", "part").agg(F.min_by("id", at).alias("first_id"), F.max_by("id", at).alias("last_id"), F.count(F.lit(1)).alias("lines"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.avg("confidence").alias("confidence")).drop("part")


#: Evidence against its label from which a text's label counts as wrong.
AGAINST = 1.0


def mislabelled(df: DataFrame, label: Column) -> Column:
    """Whether a row's label is missing or says another language than its column ``lang``.

    Where the rows have the chances of all languages, a label counts as wrong only on some evidence: a short text without a word
    of its own, such as a name, may be in any language.
    """
    code = code_of(label)
    other = code != F.col("lang")
    if "chances" in df.columns:
        at = F.array_position(F.array(*map(F.lit, LANGUAGES)), code).cast("int")
        own = F.when(at > 0, F.element_at("chances", F.greatest(at, F.lit(1))))
        evidence = F.log(F.col("confidence") / F.greatest(own, F.lit(1e-6))) * F.least(F.lit(1.0), F.col("letters") / FULL_LETTERS)
        other = other & F.coalesce(evidence >= AGAINST, F.lit(True))
    return F.coalesce(other, F.lit(True))


def classified_cues(cues: DataFrame, owner: Column, net: Network) -> DataFrame:
    """Every cue delivered, once, with its language; written to the shared folder, for it is read more than once."""
    x = cues.select(owner.alias("owner"), "id", F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"), "text").where("owner is not null and id is not null")
    return materialize(languages(x, net, ["owner", "id", "start_ms", "end_ms"]), "languages")


def segments(df: DataFrame, net: Network, key: str) -> DataFrame:
    """The stretches of each text in one language: (key, nth, lang, from_pos, to_pos, confidence), places in code points.

    A text's windows are judged in order as :func:`foreign` judges lines; its first segment begins at 0 and the last one
    ends at its length. Rows whose text is null or without a letter have none; other rows have them as often as they stand.
    """
    kind = df.select(key).schema[0].dataType.simpleString()
    arrow = pa.schema([(key, {"bigint": pa.int64(), "string": pa.string()}[kind]), ("nth", pa.int32()), ("lang", pa.string()), ("from_pos", pa.int64()), ("to_pos", pa.int64()), ("confidence", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for k, text in zip(b[key].to_pylist(), b["text"].to_pylist()):
                parts = windows_of(text)
                n = _letters(parts) if parts else np.zeros(0)
                if not n.sum():
                    continue
                p = net.predict(parts)
                e, states = _odds(p, n, int((p * n[:, None]).sum(0).argmax()))
                way = path(e)
                # a byte that begins a character is none of 10xxxxxx
                ends = np.cumsum([sum(1 for x in w if x & 0xC0 != 0x80) for w in parts])
                cut = np.flatnonzero(np.concatenate([[True], way[1:] != way[:-1]])).tolist()
                for i, (lo, hi) in enumerate(zip(cut, [*cut[1:], len(parts)])):
                    lang = states[way[lo]]
                    out.append((k, i, LANGUAGES[lang], int(ends[lo - 1]) if lo else 0, int(ends[hi - 1]), float((p[lo:hi, lang] * n[lo:hi]).sum() / max(n[lo:hi].sum(), 1e-9))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return df.select(key, "text").where("text is not null").mapInArrow(run, f"`{key}` {kind}, nth int, lang string, from_pos long, to_pos long, confidence double")
