"""A character-level bidirectional LSTM with CRF transitions, in numpy: training, batched emissions, one decode per text.

The tagger learns from labelled spans that a seeded generator writes: personal data of four kinds, in the plain forms
and in forms that patterns miss (addresses with their signs spelt or bracketed, dots in brackets, numbers without a
country code or with other signs between their groups), among words and look-alikes.

Windows overlap by half, so every character but a text's first and last has two emissions, which are averaged; one
Viterbi pass over all of them decodes a text as a whole, with the transitions respected across every seam.
"""

from __future__ import annotations

import random
import re

import numpy as np

KINDS = ["email", "ip", "card", "phone"]
#: Tags: 0 outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
WIDTH, STEP = 64, 32
#: No span longer than this is added.
LONGEST = 64
#: What every added span holds one of: a digit, or a sign of an address, plain, bracketed or spelt.
CUES = re.compile(r"[0-9@\uff20]|[\[({<]\s?(?:at|AT|dot|DOT)\s?[\])}>]|\s(?:at|AT|dot|DOT)\s")
#: Windows are emitted this far around a cue: LONGEST to each side, and as much again for the decode to settle.
REACH = 2 * LONGEST
_SYMBOLS = " \n.,:;!?@+-_()[]{}<>/\\'\"#$%&*=|~^`"
_LETTERS = "adot"  # letters that spell the signs of an address
CLASSES = 4 + len(_SYMBOLS) + len(_LETTERS)


def classes(text: str) -> np.ndarray:
    """Character classes: lower, upper, digit, other letters, each symbol, and the letters of "at" and "dot"."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    table = np.full(128, 3, dtype=np.int64)
    table[97:123], table[65:91], table[48:58] = 0, 1, 2
    for k, c in enumerate(_SYMBOLS + _LETTERS):
        table[ord(c)] = 4 + k
    return np.where(code < 128, table[np.minimum(code, 127)], 3)


def labelled(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """n windows of WIDTH character classes and their tags, cut from one generated text."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choices("0123456789", k=k))
    common = "aaaaaaaabbcccddddeeeeeeeeeeeeffgghhhhhhiiiiiiijkllllmmnnnnnnnooooooooppqrrrrrrssssssttttttttuuuvwwxyyz"
    letters = lambda lo, hi: "".join(rng.choices(common, k=rng.randrange(lo, hi)))
    one = lambda *x: rng.choice(x)

    def entity(kind: str) -> str:
        if kind == "email":
            user = letters(2, 9) + one("", "", "." + letters(2, 8), digits(2), "." + digits(2), "_" + letters(2, 5), "-" + letters(2, 4))
            host, top = letters(3, 10) + one("", "", digits(1), "-" + letters(2, 6)), one("com", "org", "net", "de", "co", "example", "io")
            user = one(user, user, user.capitalize())
            at = one("@", "@", "(at)", "[at]", "{at}", " at ", " (at) ", " [at] ", "<at>")
            dot = one(".", ".", "[dot]", "(dot)") if at[0] != " " else one(".", " dot ", "[dot]", " (dot) ", " [dot] ")
            dot = " dot " if at == " at " else dot
            return user + at + host + dot + one("", "", "", letters(2, 5) + dot) + top
        if kind == "ip":
            return one(".", ".", "[.]", "(.)", " . ").join(str(rng.randrange(256)) for _ in range(4))
        if kind == "card":
            sep = one("", " ", "-", ".", "/", "  ", "_")
            sizes = one([4, 4, 4, 4], [4, 4, 4, 4], [4, 6, 5], [4, 6, 4], [4, 4, 4, 4, 3], [6, 6, 4])
            return sep.join(digits(k) for k in sizes)
        sep = one(" ", "-", ".", "/")
        tail = sep.join(digits(k) for k in one([3, 4], [3, 4], [2, 2, 2], [4, 4], [3, 3], [3, 2, 2]))
        area = digits(rng.randrange(2, 5))
        return one(f"+{digits(1)} ({area}) {tail}", f"+{digits(2)}{sep}{area}{sep}{tail}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"({area}) {tail}", f"{digits(3)}{sep}{digits(3)}{sep}{digits(4)}", f"00{digits(2)}{sep}{area}{sep}{tail}", f"0{area}{sep}{tail}", f"0{area}/{digits(7)}")

    def filler() -> str:
        word = letters(2, 9)
        return one(
            letters(1, 9), word, word, word.capitalize(), letters(2, 7) + one(".", ",", "***", "$$$", "!", "?", ":"), one("at", "dot", "at the", "(at)", "at", "a dot"), digits(rng.randrange(1, 6)), f"{digits(1)}.{digits(2)}", f"{digits(4)}-{digits(2)}-{digits(2)}",
            f"{digits(2)}/{digits(2)}/{digits(4)}", f"{digits(2)}.{digits(2)}.{digits(4)}", f"v{digits(1)}.{digits(1)}.{digits(1)}", f"#{digits(5)}", f"{digits(2)}:{digits(2)}:{digits(2)}", f"{digits(1)},{digits(3)},{digits(3)}", f"({word} {word})", f"[{digits(2)}]", f"{digits(4)}-{digits(4)}", f"{word}_{word}", f"https://{word}.com/{letters(3, 6)}", letters(30, 40),
        )

    parts, tags, size = [], [], 0
    while size < n * WIDTH:
        k = rng.randrange(9)
        word = entity(KINDS[k]) if k < len(KINDS) else filler()
        own = [1 + 2 * k] + [2 + 2 * k] * (len(word) - 1) if k < len(KINDS) else [0] * len(word)
        between = one(" ", " ", " ", "\n", ", ", ". ", ": ", "; ")
        parts.append(word + between)
        tags += own + [0] * len(between)
        size += len(parts[-1])
    code, tag = classes("".join(parts)), np.array(tags)
    at = np.array([rng.randrange(size - WIDTH + 1) for _ in range(n)])[:, None] + np.arange(WIDTH)
    return code[at], tag[at]


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * v) + 1)


class Tagger:
    def __init__(self, hidden: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        init = lambda *s: (rng.standard_normal(s) * 0.3 / np.sqrt(s[-2] ** 0.5)).astype(np.float32)
        self.hidden = hidden
        # Of x and h the first axis is the direction. The input is one of CLASSES, so its embedding and input weights are
        # one table of gate inputs.
        self.p = {"t": np.zeros((TAGS, TAGS), np.float32), "o": init(2 * hidden, TAGS), "ob": np.zeros(TAGS, np.float32), "x": init(2, CLASSES, 4 * hidden), "h": init(2, hidden, 4 * hidden)}
        self.p["x"][:, :, hidden : 2 * hidden] += 1  # forget gates start open

    def _run(self, x: np.ndarray, keep: bool):
        """Hidden states (steps, 2, n, hidden) in the order of each direction, and what the way back needs."""
        n, steps, h = *x.shape, self.hidden
        wx, wh = self.p["x"], self.p["h"]
        both = np.stack([x.T, x.T[::-1]], axis=1)  # (steps, 2, n)
        hid, cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        out = np.zeros((steps, 2, n, h), np.float32)
        past = [np.zeros((steps, 2, n, k * h), np.float32) for k in (4, 1, 1)] if keep else []
        side = np.arange(2)[:, None]
        for t in range(steps):
            z = wx[side, both[t]] + hid @ wh
            z[..., : 3 * h] = _sigmoid(z[..., : 3 * h])
            np.tanh(z[..., 3 * h :], out=z[..., 3 * h :])
            new = z[..., h : 2 * h] * cell + z[..., :h] * z[..., 3 * h :]
            tc = np.tanh(new)
            if keep:
                past[0][t], past[1][t], past[2][t] = z, cell, tc
            cell, hid = new, z[..., 2 * h : 3 * h] * tc
            out[t] = hid
        return out, both, past

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """(steps, n, TAGS)"""
        out = self._run(x, False)[0]
        h = self.hidden
        return out[:, 0] @ self.p["o"][:h] + out[::-1, 1] @ self.p["o"][h:] + self.p["ob"]

    def viterbi(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best tags of each sequence of emissions (steps, n, TAGS); beyond a sequence's length they mean nothing."""
        steps, n, _ = e.shape
        back, score = np.zeros((steps, n, TAGS), np.int8), e[0].copy()
        for t in range(1, steps):
            way = score[:, :, None] + self.p["t"]
            back[t] = way.argmax(1)
            # A sequence that has ended keeps its score, and each tag leads back to itself.
            on = (t < lengths)[:, None]
            score = np.where(on, way.max(1) + e[t], score)
            back[t] = np.where(on, back[t], np.arange(TAGS))
        tags = np.zeros((n, steps), np.int8)
        tags[:, -1] = score.argmax(1)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = back[t, np.arange(n), tags[:, t]]
        return tags

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Tags of each window by itself."""
        return self.viterbi(self.emissions(x), np.full(len(x), x.shape[1]))

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The CRF's mean negative log-likelihood of the tags, and its gradients."""
        h = self.hidden
        out, both, (gates, cells, tcs) = self._run(x, True)
        states = np.concatenate([out[:, 0], out[::-1, 1]], axis=2)
        e = states @ self.p["o"] + self.p["ob"]
        steps, n, _ = e.shape
        # Forward and backward sums, scaled at every step.
        top = e.max(2, keepdims=True)
        ee, way = np.exp(e - top), np.exp(self.p["t"])
        a, b, c = np.zeros_like(e), np.ones_like(e), np.zeros((steps, n, 1), e.dtype)
        for t in range(steps):
            v = ee[t] if t == 0 else (a[t - 1] @ way) * ee[t]
            c[t] = v.sum(1, keepdims=True)
            a[t] = v / c[t]
        for t in range(steps - 2, -1, -1):
            b[t] = ((b[t + 1] * ee[t + 1]) @ way.T) / c[t + 1]
        de = a * b
        gt = way * (a[:-1].reshape(-1, TAGS).T @ (ee[1:] * b[1:] / c[1:]).reshape(-1, TAGS))
        row, col = np.arange(steps)[:, None], np.arange(n)[None, :]
        right = e[row, col, y.T].sum() + self.p["t"][y[:, :-1], y[:, 1:]].sum()
        nll = (np.log(c).sum() + top.sum() - right) / n
        np.add.at(gt, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
        de[row, col, y.T] -= 1
        g = {"t": gt, "o": states.reshape(-1, 2 * h).T @ de.reshape(-1, TAGS), "ob": de.sum((0, 1))}
        dstates = de @ self.p["o"].T
        dout = np.stack([dstates[..., :h], dstates[::-1, :, h:]], axis=1)
        dz = np.zeros((steps, 2, n, 4 * h), np.float32)
        dh, dc, back = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32), self.p["h"].transpose(0, 2, 1)
        for t in range(steps - 1, -1, -1):
            z, tc = gates[t], tcs[t]
            i, f, o, m = (z[..., k * h : (k + 1) * h] for k in range(4))
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - tc * tc)
            d = dz[t]
            d[..., :h], d[..., h : 2 * h] = dc * m * i * (1 - i), dc * cells[t] * f * (1 - f)
            d[..., 2 * h : 3 * h], d[..., 3 * h :] = dh * tc * o * (1 - o), dc * i * (1 - m * m)
            dh, dc = d @ back, dc * f
        before = np.concatenate([np.zeros((1, 2, n, h), np.float32), out[:-1]])
        flat = lambda v: v.transpose(1, 0, 2, 3).reshape(2, steps * n, -1)
        dzs = flat(dz)
        g["h"] = flat(before).transpose(0, 2, 1) @ dzs
        g["x"] = np.stack([np.eye(CLASSES, dtype=np.float32)[both[:, d].ravel()].T @ dzs[d] for d in range(2)])
        return float(nll), {k: v / n for k, v in g.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int, rate: float = 0.01, seed: int = 11) -> Tagger:
        rng = np.random.default_rng(seed)
        m1, m2 = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            at = rng.integers(0, len(x), batch)
            now = rate * (1 - step / (steps + 1))
            for k, g in self.loss(x[at], y[at])[1].items():
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.99 * m2[k] + 0.01 * g * g
                self.p[k] = (self.p[k] - now * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self

    def tag(self, texts: list[str], every: bool = False) -> list[list[tuple[int, np.ndarray]]]:
        """For each text its decoded stretches: (start, tags). With every, whole texts are decoded.

        Windows of WIDTH start every STEP characters. Only windows within REACH of a cue are emitted: a span that is
        added holds a cue and is at most LONGEST long, so it lies inside, with as much again around it.
        """
        jobs: list[tuple[int, int, int]] = []  # text, first character, one after the last
        for k, text in enumerate(texts):
            if every:
                jobs += [(k, 0, len(text))] if text else []
                continue
            for m in CUES.finditer(text):
                lo, hi = max(0, (m.start() - REACH) // STEP * STEP), min(len(text), m.end() + REACH)
                if jobs and jobs[-1][0] == k and lo <= jobs[-1][2]:
                    jobs[-1] = (k, jobs[-1][1], max(hi, jobs[-1][2]))
                else:
                    jobs.append((k, lo, hi))
        out: list[list[tuple[int, np.ndarray]]] = [[] for _ in texts]
        code = {k: classes(texts[k]) for k in {k for k, _, _ in jobs}}
        # Stretches of like length are decoded together, as many as make some 2,000 windows.
        jobs.sort(key=lambda j: j[2] - j[1])
        at = 0
        while at < len(jobs):
            end, room = at, 0
            while end < len(jobs) and (end == at or room + (jobs[end][2] - jobs[end][1]) // STEP <= 2000):
                room += (jobs[end][2] - jobs[end][1]) // STEP + 2
                end += 1
            part = jobs[at:end]
            for (k, lo, _), tags in zip(part, self._stretches([code[k][lo:hi] for k, lo, hi in part]), strict=True):
                out[k].append((lo, tags))
            at = end
        return [sorted(o, key=lambda s: s[0]) for o in out]

    def _stretches(self, codes: list[np.ndarray]) -> list[np.ndarray]:
        """Tags of sequences of classes: averaged emissions of the two windows of each character, decoded as one."""
        lengths = np.array([len(c) for c in codes])
        halves = -(-lengths // STEP)
        whole = np.full((int((halves + 2).sum()), STEP), 4, np.int64)  # half windows, a blank one before and after each
        first = np.cumsum(halves + 2) - (halves + 2)
        for c, f in zip(codes, first.tolist(), strict=True):
            whole[f + 1 : f + 2 + len(c) // STEP].reshape(-1)[: len(c)] = c
        lead = np.concatenate([np.arange(f, f + h + 1) for f, h in zip(first.tolist(), halves.tolist(), strict=True)])
        emitted = np.zeros((len(whole), STEP, TAGS), np.float32)
        for k in range(0, len(lead), 1024):
            w = lead[k : k + 1024]
            e = self.emissions(np.concatenate([whole[w], whole[w + 1]], axis=1)).transpose(1, 0, 2) * np.float32(0.5)
            emitted[w] += e[:, :STEP]
            emitted[w + 1] += e[:, STEP:]
        steps = int(lengths.max())
        every = np.zeros((steps, len(codes), TAGS), np.float32)
        for k, (f, n) in enumerate(zip(first.tolist(), lengths.tolist(), strict=True)):
            every[:n, k] = emitted[f + 1 : f + 2 + n // STEP].reshape(-1, TAGS)[:n]
        tags = self.viterbi(every, lengths)
        return [t[:n] for t, n in zip(tags, lengths.tolist(), strict=True)]


def spans_of(tags: np.ndarray) -> list[tuple[str, int, int]]:
    out, at, n = [], 0, len(tags)
    for at in np.flatnonzero(tags % 2 == 1).tolist():
        kind, end = int(tags[at]), at + 1
        while end < n and tags[end] == kind + 1:
            end += 1
        out.append((KINDS[kind // 2], at, end))
    return out


_TRAINED: dict[tuple, Tagger] = {}


def trained(windows: int = 8000, steps: int = 600, batch: int = 64, hidden: int = 32, seed: int = 7, rate: float = 0.02) -> Tagger:
    """A tagger fitted on generated labelled spans; the same for the same parameters. Trained once per process."""
    key = (windows, steps, batch, hidden, seed, rate)
    if key not in _TRAINED:
        _TRAINED[key] = Tagger(hidden, seed).fit(*labelled(windows, seed), steps, batch, rate)
    return _TRAINED[key]
