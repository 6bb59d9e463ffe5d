"""Abusive, hateful and sexual content by classifier chains.

A text is folded (broken encodings, entities, accents, look-alike letters,
spaced-out words), cut into words and into passages: sentences, long ones in
overlapping windows. A word is described by its own weight and its meaning by a
small lexicon of general vocabulary, of which disguised spellings (letters
written as digits, masked or repeated) also count. A passage is described by its
words, word pairs, lexicon groups and pairs of groups. Along a chain, one linear
model per category (abusive at all, insult, threat, hate, sexual) is fitted: each
also sees the earlier categories' probabilities, at fitting time from models that
did not see the passage (out of fold; all passages of a document are in one
fold). A document's score is that of its worst passage.

The seed sentences below only start the chain and tell the categories apart; what
the texts at hand look like is learned from reviewed documents, at most
``max_labelled`` of them, taken by the hash of their id. A review says nothing
about passages: of a document called abusive the worst passage counts as abusive,
of a harmless one all count as harmless, in a few rounds with refitted models.
Reviewers err: a document counts by majority (a tie not at all), and passages
that contradict a model that has not seen them count little.

Scoring is done on whole batches with arrays: weights by hash of word and word
pair, running sums over passages. Documents are only mapped over; the model is a
table of fixed size.

Defined results:
* null and blank texts have score 0 in every category and no passage;
* an empty or missing table of reviews fits on the seeds alone;
* repeated rows get equal scores; an empty table gives an empty table;
* input columns named like an output column are renamed ``*_in``.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.columns import shield

CATEGORIES = ("insult", "threat", "hate", "sexual")
CHAIN = ("abusive", *CATEGORIES)
OUT = (*CATEGORIES, "score", "flagged", "passage")

#: General vocabulary by group, folded to plain lower-case letters.
LEXICON_GROUPS = {
    "name": "idiot idiots moron morons fool dimwit halfwit cretin imbecile asshole arsehole dickhead prick bastard bastards bitch bitches whore slut "
    "hag scumbag scum wanker tosser twat cunt loser losers parasite pig swine jerk creep coward retard motherfucker cocksucker douchebag "
    "arschloch wichser hurensohn schlampe drecksau missgeburt fotze trottel depp vollidiot spasti mistkerl "
    "connard connasse salope encule abruti batard pouffiasse cretin ordure debile "
    "cabron gilipollas puta pendejo maricon imbecil payaso ramera zorra basura subnormal idiota baka kuzu aho",
    "slight": "stupid dumb dumbest useless worthless brainless pathetic disgusting filthy ugly fat stinking miserable retarded dumm dumme blod blode "
    "hasslich widerlich dreckig stupide moche sale minable feo asqueroso inutil estupido asquerosa",
    "curse": "fuck fucking fucked shit bullshit crap damn hell sucks scheisse scheiss verdammt verpiss merde putain foutre gueule mierda joder carajo",
    "harm": "kill kills killed murder cut slit stab shoot strangle choke hang burn drown beat smash break bleed hurt die rape hunt bury "
    "umbringen toten verrecken schlagen erschiessen verprugeln tuer crever egorger casser frapper mourir matar matare muerte mueras golpear degollar",
    "body": "throat neck face skull teeth bones legs knife gun grave kehle zahne fresse hals gorge cou dents cara cuello dientes huesos",
    "vile": "vermin subhuman filth animals rats cockroaches plague disease infestation breed breeding exterminate wipe deport inferior "
    "ungeziefer untermenschen abschaum vermine racaille parasites alimanas plaga escoria",
    "sex": "cock dick tits boobs nude nudes naked horny porn porno hardcore orgy cum pussy blowjob anal masturbate orgasm erection penis vagina nipples "
    "ficken schwanz titten geil nackt muschi baiser bite chatte nichons nue follar polla tetas desnuda coño cono culo",
    "scene": "lips mouth tongue thighs knees bed moan moaned moaning lick licking undressed touching kiss naked body hard wet spread tonight",
    "you": "you your yours yourself u ur du dich dir dein deine deiner tu te toi ton ta tes vous eres usted tus he she him his her them they their",
    "self": "i my mine me myself ich mein meine mir je mon ma moi yo mi soy",
    "fault": "mistake forgot wrong typo sorry confused oops vergessen fehler oublie erreur olvide error",
    "machine": "process thread daemon job server node cluster child parent master slave worker socket cache disk memory script command file archive "
    "table column code codes build compiler test branch terminal signal task queue prozess befehl datei processus fichier proceso archivo comando",
    "science": "clinic clinical doctor patient patients hospital medical medicine therapy surgery diagnosis screening cancer anatomy biology species zoo bird "
    "birds insect breeder kennel veterinary recipe cooking oven leaflet prevention museum glossary review critics novel film",
}
GROUPS = tuple(LEXICON_GROUPS)
#: Groups that may stand for abuse by themselves.
STRONG = frozenset(("name", "slight", "curse", "harm", "vile", "sex"))
LEXICON: dict[str, int] = {}
for _bit, _words in enumerate(LEXICON_GROUPS.values()):
    for _w in _words.split():
        LEXICON[_w] = LEXICON.get(_w, 0) | 1 << _bit
_STRONG_BITS = sum(1 << k for k, g in enumerate(GROUPS) if g in STRONG)

_LOOKS = str.maketrans("авеёкмнорстухіјѕԁɡαεικνορτυχßı", "abeekmhopctyxijsdgaeiknoptuxsi")
_LEET = str.maketrans("013457@$!", "oieastasi")
_SPACED = re.compile(r"(?<![\w*])[\w*](?:([ \-_])(?:[\w*]\1){2,}|\.(?:[\w*]\.)+)[\w*](?![\w*])")
_TOKEN = re.compile(r"[\w*@$]+(?:[/.'][\w*@$]+)*|[.!?。！？\n\r\x1e]")
_MARKS = regex.compile(r"[\p{M}\p{Cf}]+")
_RUN = re.compile(r"(.)\1+")
_SQUEEZED = {_RUN.sub(r"\1", w): w for w in reversed(LEXICON) if len(w) >= 4}
_ENDS = {".", "!", "?", "。", "！", "？", "\n", "\r"}
#: Words of a window, and the step between windows of a long sentence.
WINDOW, STRIDE = 12, 6
#: Weights are kept by hash of word and word pair.
SLOTS = 1 << 18


def _joined(m: re.Match) -> str:
    word = re.sub(r"[ .\-_]", "", m[0])
    # a one-letter word may stand right before the spaced-out one
    return f"{word[0]} {word[1:]}" if word[1:] in LEXICON and word not in LEXICON else word


def fold(text: str) -> str:
    """Lower case without accents, look-alikes, entities or broken encoding."""
    text = text.replace("\x1e", " ")
    if "&" in text:
        text = html.unescape(text)
    if "Ã" in text or "â€" in text:
        for code, how in (("cp1252", "strict"), ("latin-1", "ignore")):
            try:
                text = text.encode(code, how).decode("utf-8", how)
                break
            except UnicodeError:
                continue
    if text.isascii():
        text = text.lower()
    else:
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text.lower())).translate(_LOOKS)
    return _SPACED.sub(_joined, text)


def canonical(token: str) -> str:
    """The lexicon word a token stands for, '<id>', '<n>', or the token."""
    if token in LEXICON:
        return token
    if "*" in token:
        bare = token.strip("*")
        if "*" in bare:
            fit = re.compile(re.escape(bare).replace(r"\*", "[a-z]"))
            return next((w for w in LEXICON if len(w) == len(bare) and fit.fullmatch(w)), bare)
        token = bare
        if token in LEXICON:
            return token
    if token.isdigit():
        return "<n>"
    short = _RUN.sub(r"\1", token)
    if not token.isalpha():
        plain = token.translate(_LEET)
        if plain in LEXICON:
            return plain
        squeezed = _RUN.sub(r"\1", plain)
        if squeezed in _SQUEEZED and "_" not in token and "/" not in token:
            return _SQUEEZED[squeezed]
        if any(c in token for c in "_/.") or any(c.isdigit() for c in token):
            return "<id>"
    elif short != token and short in _SQUEEZED and (len(token) >= 6 or re.search(r"(.)\1\1", token)):
        return _SQUEEZED[short]
    return token


class Words:
    """Numbers words as they are met, with their slot and lexicon groups. Number
    0 ends a text, 1 ends a sentence, 2 is the word ``die`` (an article in German:
    no harm unless told to somebody)."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {"\x1e": 0, **dict.fromkeys(_ENDS, 1)}
        self.hashes, self.masks = [0, 0], [0, 0]
        self._number("die")
        self.masks[2] = 0
        self.urge = {self._number(w) for w in "you to should will must go and just please can would they them hope".split()}

    def _number(self, token: str) -> int:
        word = canonical(token)
        got = self.numbers.get(word)
        if got is None:
            got = self.numbers[word] = len(self.hashes)
            self.hashes.append(xxhash.xxh64_intdigest(word))
            self.masks.append(LEXICON.get(word, 0))
        self.numbers[token] = got
        return got

    def read(self, folded: list[str]) -> np.ndarray:
        numbers, new = self.numbers, self._number
        tokens = _TOKEN.findall("\x1e".join(folded) + "\x1e")
        out = np.empty(len(tokens), np.int64)
        for i, t in enumerate(tokens):
            n = numbers.get(t)
            out[i] = new(t) if n is None else n
        return out


class Passages:
    """The passages of a batch of texts as arrays: ``doc``, ``start`` and ``end``
    (in words), and per word its slot, pair slot and groups."""

    def __init__(self, texts: list, words: Words) -> None:
        if len(words.hashes) > 1_000_000:
            words.__init__()
        n = words.read([fold(t) if t else "" for t in texts])
        text_of = np.concatenate([[0], np.cumsum(n == 0)])[:-1]
        part = np.cumsum(n <= 1)
        keep = n > 1
        n, part, text_of = n[keep], part[keep], text_of[keep]
        first = np.ones(len(n), bool)
        first[1:] = part[1:] != part[:-1]
        begin = np.flatnonzero(first)
        length = np.diff(np.append(begin, len(n)))
        count = np.where(length <= WINDOW, 1, -((STRIDE - length) // STRIDE))
        which = np.repeat(np.arange(len(begin)), count)
        step = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        self.start = begin[which] + step * STRIDE
        self.end = np.minimum(self.start + WINDOW, (begin + length)[which])
        self.doc = text_of[begin][which] if len(begin) else np.empty(0, np.int64)
        self.ids = n
        h = np.array(words.hashes, np.uint64)[n]
        with np.errstate(over="ignore"):
            pair = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
            pair ^= pair >> np.uint64(29)
        self.slot = (h % np.uint64(SLOTS)).astype(np.int64)
        self.pair = np.append((pair % np.uint64(SLOTS)).astype(np.int64), 0)  # of a word and the next
        mask = np.array(words.masks, np.int64)[n]
        if len(n):
            urged = np.isin(n, list(words.urge))
            mask[1:] |= np.where((n[1:] == 2) & urged[:-1], 1 << GROUPS.index("harm"), 0)
        ends = np.stack([self.start, self.end], 1).ravel()
        self.groups = np.bitwise_or.reduceat(np.append(mask, 0), ends)[::2] if len(ends) else np.empty(0, np.int64)

    def __len__(self) -> int:
        return len(self.start)

    def sums(self, single: np.ndarray, double: np.ndarray) -> np.ndarray:
        """Per passage the sum of the weights of its words and pairs."""
        total = np.zeros((len(self.ids) + 1, single.shape[1]))
        np.cumsum(single[self.slot], axis=0, out=total[1:])
        out = total[self.end] - total[self.start]
        np.cumsum(double[self.pair], axis=0, out=total[1:])
        return out + total[np.maximum(self.end - 1, self.start)] - total[self.start]


_PAIRS = [(a, b) for a in range(len(GROUPS)) for b in range(a + 1, len(GROUPS))]


def group_features(groups: np.ndarray) -> np.ndarray:
    """Groups and pairs of groups that a passage has, as 0 or 1."""
    own = (groups[:, None] >> np.arange(len(GROUPS))) & 1
    both = np.stack([own[:, a] & own[:, b] for a, b in _PAIRS], 1)
    return np.concatenate([own, both], 1).astype(np.float64)


def _expand(templates: str, **slots: str) -> list[str]:
    out = []
    for line in templates.strip().split("\n"):
        found = [line]
        for name, values in slots.items():
            key = "{" + name + "}"
            found = [f.replace(key, v, 1) for f in found for v in (values.split("|") if key in f else [""])]
        out += found
    return out


_NAMES = "idiot|asshole|bitch|loser|bastard"
_PEOPLE = "foreigners|refugees|villagers|newcomers|southerners"
#: Seed sentences per category; "" are harmless ones.
SEEDS: dict[str, list[str]] = {
    "insult": _expand(
        """You really are a stupid {n}.
Only a {n} writes something like that.
He is a worthless {n} and always was.
My neighbour, that fat ugly {n}, came by again.
Piss off, {n}, nobody asked for your opinion.
You are too dumb to breathe.
What an ugly face you have.
They called her a filthy whore.
Du bist ein dummes Arschloch.
Dein Bruder ist ein Trottel.
Verpiss dich, du hässliche Kuh.
Ta gueule, espèce de connard.
Quel abruti, tu es vraiment débile.
Qué gilipollas eres, tío.
Tu hermano es un payaso asqueroso.""", n=_NAMES),
    "threat": _expand(
        """I am going to kill you tonight.
One more word and I break your neck.
I will come to your house and stab you, {n}.
You will bleed for this.
Go hang yourself, {n}.
You deserve to die slowly.
Somebody should shoot him in the face.
I will burn you and your family.
Ich werde dich umbringen.
Ich breche dir alle Knochen.
Je vais te tuer.
Je vais te casser les dents.
Te voy a matar.
Te voy a romper los huesos.""", n=_NAMES),
    "hate": _expand(
        """{g} are vermin.
{g} are nothing but animals and rats.
We have to get rid of all {g}, they are a disease.
Those filthy {g} breed everywhere.
{g} are inferior, wipe them out.
Deport every one of these {g}.
You cannot trust {g}, they are all thieves and liars.
Die Ausländer sind Ungeziefer und müssen weg.
Les étrangers sont de la vermine.
Los extranjeros son una plaga.""", g=_PEOPLE),
    "sexual": _expand(
        """She sucked his cock until he had an orgasm.
He licked her nipples and pushed his penis inside.
I masturbate and think of your naked body.
Show me your tits, I am so horny.
Hardcore porn with wet pussy and anal.
They fucked in bed all night.
Her hand moved up his thighs and he moaned.
Du machst mich geil, zeig mir deine Titten.
J'ai envie de te baiser toute nue.
Quiero follar contigo desnuda."""),
    "": _expand(
        """The parent process has to kill its child before it exits.
The master sends a command to the slave node, then the daemon dies.
Kill the job, cut the branch and burn the old disk image.
I am an idiot, it was my own mistake.
Stupid me, I forgot the password.
This damn compiler is crap and I hate the build.
What the hell is this shit, the server is down again.
Das verdammte Skript ist Scheisse.
Quelle merde, ce serveur.
The bitch had six puppies at the kennel.
A cock crows, an ass brays, a bird called tit builds a nest.
The doctor examined the breast of the patient for cancer.
The lecture on anatomy covers penis and vagina.
Rats carry disease, said the veterinary.
Your proposal is wrong and badly written.
The critics called the film a bloody mess.
A helpline for people who think of killing themselves.
Thank you for the quick answer.
Please send the report until Friday.
Können wir morgen telefonieren?
Merci beaucoup pour ton aide.
La reunión empieza a las nueve."""),
}


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Design:
    """Training rows: sparse word and pair columns, dense group columns."""

    def __init__(self, parts: list[Passages], chosen: list[np.ndarray]) -> None:
        at, col, groups, n = [], [], [], 0
        for p, rows in zip(parts, chosen):
            for shift, values, last in ((0, p.slot, 0), (SLOTS, p.pair, 1)):
                size = np.maximum(p.end[rows] - p.start[rows] - last, 0)
                who = np.repeat(np.arange(len(rows)), size)
                off = np.arange(len(who)) - np.repeat(np.cumsum(size) - size, size)
                at.append(who + n)
                col.append(values[p.start[rows][who] + off] + shift)
            groups.append(group_features(p.groups[rows]))
            n += len(rows)
        at, col = np.concatenate(at), np.concatenate(col)
        seen = np.bincount(col, minlength=2 * SLOTS)
        common = seen[col] >= 2  # what occurs once teaches nothing
        self.n, self.at = n, at[common]
        self.names, self.col = np.unique(col[common], return_inverse=True)
        self.groups = np.concatenate(groups)

    def part(self, rows: np.ndarray) -> Design:
        out = object.__new__(Design)
        place = np.full(self.n, -1)
        place[rows] = np.arange(len(rows))
        keep = place[self.at] >= 0
        out.n, out.at, out.col, out.names, out.groups = len(rows), place[self.at[keep]], self.col[keep], self.names, self.groups[rows]
        return out

    def fit(self, before: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Logistic regression (word weights, group weights, chain weights, bias)
        by accelerated gradients with a diagonal scale."""
        dense = np.concatenate([self.groups, before], 1)
        w, v, b = np.zeros(len(self.names)), np.zeros(dense.shape[1]), 0.0
        gw, gv, gb = np.full(len(w), 1e-8), np.full(len(v), 1e-8), 1e-8
        total = weight.sum()
        for _ in range(rounds):
            r = (_sigmoid(self.dot(w) + dense @ v + b) - y) * weight / total
            dw = np.bincount(self.col, r[self.at], len(w)) + 1.0 * w / total
            dv = dense.T @ r + 0.3 * v / total
            db = r.sum()
            gw, gv, gb = gw + dw * dw, gv + dv * dv, gb + db * db
            w -= 0.3 * dw / np.sqrt(gw)
            v -= 0.3 * dv / np.sqrt(gv)
            b -= 0.3 * db / np.sqrt(gb)
        k = self.groups.shape[1]
        return w, v[:k], v[k:], b

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, w[self.col], self.n)

    def apply(self, model: tuple, before: np.ndarray) -> np.ndarray:
        w, g, c, b = model
        return _sigmoid(self.dot(w) + self.groups @ g + before @ c + b)


def fit_chain(rows: Design, labels: np.ndarray, weight: np.ndarray, fold: np.ndarray, rounds: int = 30) -> tuple[dict, np.ndarray]:
    """(model, out-of-fold probabilities). ``labels`` has a column per link of the
    chain; rows of one ``fold`` are predicted by the others' models."""
    before = np.zeros((rows.n, 0))
    models = []
    for k in range(labels.shape[1]):
        y = labels[:, k]
        # both classes weigh alike within a factor of four
        heavy = min(4.0, max(1.0, (weight * (1 - y)).sum() / max((weight * y).sum(), 1e-9)))
        balance = weight * np.where(y > 0, heavy, 1.0)
        models.append(rows.fit(before, y, balance, rounds))
        out = np.zeros(rows.n)
        for f in np.unique(fold):
            a, b = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            part = rows.part(a).fit(before[a], y[a], balance[a], rounds * 2 // 3) if len(a) else models[-1]
            out[b] = rows.part(b).apply(part, before[b])
        before = np.column_stack([before, out])
    single, double = np.zeros((SLOTS, len(models))), np.zeros((SLOTS, len(models)))
    for k, m in enumerate(models):
        one = rows.names < SLOTS
        single[rows.names[one], k] = m[0][one]
        double[rows.names[~one] - SLOTS, k] = m[0][~one]
    model = {
        "single": single.astype(np.float32), "double": double.astype(np.float32), "groups": np.stack([m[1] for m in models], 1),
        "chain": [m[2] for m in models], "bias": np.array([m[3] for m in models]),
    }
    return model, before


def predict(model: dict, p: Passages) -> np.ndarray:
    """Probabilities along the chain: a row per passage."""
    if not len(p):
        return np.zeros((0, len(CHAIN)))
    masks, at = np.unique(p.groups, return_inverse=True)
    z = p.sums(model["single"], model["double"]) + (group_features(masks) @ model["groups"])[at] + model["bias"]
    out = np.zeros_like(z)
    for k in range(z.shape[1]):
        out[:, k] = _sigmoid(z[:, k] + out[:, :k] @ model["chain"][k])
    return out


def _seed_rows() -> tuple[list[str], np.ndarray, np.ndarray]:
    """(sentences, labels, weights), with a harmless one that holds nothing
    known: as heavy as many, it stands for what most texts are like."""
    texts, y = [], []
    for c, lines in SEEDS.items():
        for s in lines:
            texts.append(re.sub(r"[.!?](?=\s)", ",", s))  # one passage each
            y.append([float(c != ""), *[float(c == k) for k in CATEGORIES]])
    texts.append("0")
    y.append([0.0] * len(CHAIN))
    return texts, np.array(y), np.array([1.0] * (len(texts) - 1) + [50.0])


def train(labelled: list[tuple[str, int]], rounds: int = 2, folds: int = 3) -> dict:
    """Fits the chain on the seeds and reviewed (text, abusive) pairs."""
    words = Words()
    texts, seed_y, seed_w = _seed_rows()
    seeds = Passages(texts, words)
    only, at = np.unique(seeds.doc, return_index=True)
    seed_fold = only % folds
    model, _ = fit_chain(Design([seeds], [at]), seed_y, seed_w, seed_fold, 120)
    labelled = [(t, y) for t, y in labelled if t and t.strip()]
    if not labelled:
        return model
    docs = Passages([t for t, _ in labelled], words)
    abusive = np.array([y for _, y in labelled])[docs.doc] > 0
    rows = Design([seeds, docs], [at, np.arange(len(docs))])
    fold = np.concatenate([seed_fold, docs.doc % folds])
    p = predict(model, docs)  # the seeds' model has seen no document
    for turn in range(rounds):
        worst = _worst(docs.doc, p[:, 0])
        hit = abusive & worst
        strong = (docs.groups & _STRONG_BITS) > 0
        y = np.zeros((len(docs), len(CHAIN)))
        best = p[:, 1:].argmax(1)
        y[hit, 0] = 1.0
        y[hit] = np.maximum(y[hit], np.column_stack([np.zeros(hit.sum()), p[hit, 1:] >= 0.5]))
        y[np.flatnonzero(hit), 1 + best[hit]] = 1.0
        # of abusive documents only the worst passage is known; a review that the
        # model contradicts may be an error and counts less
        weight = np.where(abusive & ~worst, 0.0, 1.0)
        doubt = np.where(hit, np.clip(p[:, 0] * 2, 0.1, 1.0) * np.where(strong, 1.0, 0.5), np.where(p[:, 0] > 0.5, 0.15, 1.0))
        weight = weight * doubt
        y_all = np.concatenate([seed_y, y])
        w_all = np.concatenate([seed_w, weight])
        model, held = fit_chain(rows, y_all, w_all, fold)
        p = held[len(at) :]
    return model


def _worst(doc: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Marks the first of the highest scores of every document."""
    order = np.lexsort((np.arange(len(doc)), -score, doc))
    out = np.zeros(len(doc), bool)
    first = np.ones(len(doc), bool)
    first[1:] = doc[order][1:] != doc[order][:-1]
    out[order[first]] = True
    return out


def labelled_sample(docs: DataFrame, doc_id: str, text: str, reviews: DataFrame, most: int) -> list[tuple[str, int]]:
    """(text, abusive) of at most ``most`` reviewed documents, by majority."""
    votes = (
        reviews.where(F.col("abusive").isNotNull())
        .groupBy(F.col(doc_id).alias("__d"))
        .agg(F.avg("abusive").alias("share"))
        .where(F.col("share") != 0.5)
    )
    picked = votes.orderBy(F.xxhash64("__d"), "__d").limit(most)
    rows = (
        docs.select(F.col(doc_id).alias("__k"), F.col(text).alias("t"))
        .join(picked, F.col("__k") == F.col("__d"))
        .where(F.col("t").isNotNull())
        .select("__k", "t", (F.col("share") > 0.5).cast("int").alias("y"))
        .dropDuplicates(["__k"])
        .collect()
    )
    return [(r["t"], r["y"]) for r in sorted(rows, key=lambda r: str(r["__k"]))]


class Scorer:
    """Scores texts batch by batch; words keep their numbers between batches."""

    def __init__(self, model: dict, letters: int = 2_000_000) -> None:
        self.model, self.letters, self.words = model, letters, Words()

    def _some(self, texts: list) -> pd.DataFrame:
        p = Passages(texts, self.words)
        q = predict(self.model, p)
        out = np.zeros((len(texts), len(CHAIN)))
        np.maximum.at(out, p.doc, q)
        total = q.max(1, initial=0.0)
        passage: list[str | None] = [None] * len(texts)
        spelled = {}
        for t, n in self.words.numbers.items():  # a word is spelled as it was first met
            spelled.setdefault(n, t)
        for i in np.flatnonzero(_worst(p.doc, total) & (total >= 0.01)):
            passage[p.doc[i]] = " ".join(spelled[n] for n in p.ids[p.start[i] : p.end[i]].tolist())
        got = pd.DataFrame(out[:, 1:], columns=list(CATEGORIES))
        return got.assign(score=out.max(1), passage=passage)

    def score(self, texts: list) -> pd.DataFrame:
        """``insult, threat, hate, sexual, score, passage`` of every text."""
        parts, held, size = [], [], 0
        for t in texts:
            held.append(t)
            size += len(t) if t else 0
            if size > self.letters:
                parts.append(self._some(held))
                held, size = [], 0
        if held or not parts:
            parts.append(self._some(held))
        return pd.concat(parts, ignore_index=True)


def score_toxicity(df: DataFrame, text: str, model: dict, threshold: float = 0.5) -> DataFrame:
    """Adds ``insult, threat, hate, sexual, score, flagged, passage`` (the worst
    passage as the model reads it, folded to plain words, for review)."""
    if text in OUT:
        df, text = df.withColumnRenamed(text, f"{text}_in"), f"{text}_in"
    df = shield(df, OUT)
    shared = df.sparkSession.sparkContext.broadcast(model)  # tables of SLOTS rows, whatever the data
    kinds = ", ".join(f"{c} double" for c in CATEGORIES)

    @F.pandas_udf(f"{kinds}, score double, passage string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for s in batches:
            yield scorer.score(list(s))

    kept = [F.col(f"`{c}`") for c in df.columns]
    return df.select(*kept, run(F.col(text)).alias("__s")).select(
        *kept, *[F.col(f"__s.{c}") for c in CATEGORIES], "__s.score", (F.col("__s.score") >= threshold).alias("flagged"), "__s.passage"
    )
