"""Trains the block labeller: ``python -m spindrift.llm.html_train [OUT]``.

A seeded generator makes pages in many layouts, each block marked as main text or not; the network
is fitted to them by back-propagation through time with Adam, in numpy.
"""

from __future__ import annotations

import random
import sys

import numpy as np

from spindrift.llm import html_extract as H

HIDDEN = 20
EMBED = 32
# What layouts call things. Main text stands in one of MAIN; the rest is not main text.
MAIN = ("<article>", "<article>", "<main>", '<div class="entry-content">', '<td class="text">', '<div class="body"><div class="inner"><div class="text">', '<div class="content">', '<div id="main">', '<div class="post-body">', '<section class="entry">', '<div class="story">', '<div class="article text">', "<main><article>", '<div class="wrapper"><article>')
SYLLABLES = {
    "en": "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve the and".split(),
    "de": "en er ch te de nd ie ge st in sch un ei be au ung keit heit lich ver ö ü ß ä der die das".split(),
    "fr": "es le de en re nt on er te el an se et la is ur eau aux é è ê ç oi que les".split(),
    "es": "de en es os la el ra as on ar te do ue ien ció ñ í ó que los con mente".split(),
}


class Pages:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.lang = "en"

    def word(self) -> str:
        s = SYLLABLES[self.lang]
        return "".join(self.r.choice(s) for _ in range(self.r.randint(1, 4)))

    def words(self, lo: int, hi: int) -> str:
        r, out, big = self.r, [], True
        for _ in range(r.randint(lo, hi)):
            w = self.word()
            out.append(w.capitalize() if big else w)
            big = r.random() < 0.1
            out[-1] += "." if big else "," if r.random() < 0.05 else ""
        return " ".join(out) + (r.choice((".", ".", "!", "?", "")) if not big else "")

    def tag(self, name: str, inner: str, cls: str | None = None) -> str:
        key = self.r.choice(("class", "class", "id", "role")) if cls else ""
        return f'<{name} {key}="{cls}">{inner}</{name}>' if cls else f"<{name}>{inner}</{name}>"

    def menu(self) -> str:
        r = self.r
        links = [f'<a href="/{self.word()}">{self.word()}</a>' for _ in range(r.randint(3, 9))]
        inner = "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>" if r.random() < 0.7 else r.choice((" ", " | ")).join(links)
        return r.choice((lambda: self.tag("nav", inner), lambda: self.tag("div", inner, r.choice(("nav", "menu", "navigation", "breadcrumb", "topbar", "links", "tabs")))))()

    def short(self) -> str:
        return self.words(2, 14)

    def boiler(self) -> str:
        """One piece that is not main text."""
        r = self.r
        kind = r.randrange(12)
        p = lambda x: f"<p>{x}</p>" if r.random() < 0.5 else x
        if kind == 0:
            return self.menu()
        if kind == 1:
            return self.tag("div", p(self.words(2, 40)), r.choice(("ad", "ads", "advert", "advertisement", "banner", "sponsor", "promo", "sponsored", "ad box")))
        if kind == 2:
            return self.tag("aside", r.choice((self.menu, lambda: f"<h3>{self.short()}</h3>" + p(self.words(3, 60))))(), r.choice((None, "sidebar", "related", "widget")))
        if kind == 3:
            return self.tag("div", f"<h4>{self.short()}</h4>" + "".join(f"<p>{self.words(2, 40)}</p>" for _ in range(r.randint(1, 3))), r.choice(("sidebar", "related", "widget", "recommend", "share", "social", "newsletter", "subscribe", "popular")))
        if kind == 4:
            return self.tag("div", p(self.words(4, 40)) + r.choice(("", "<button>OK</button>")), r.choice(("cookie", "cookies", "cookie-notice", "consent", "gdpr", "notice", "alert", "modal", "popup", "privacy-banner")))
        if kind == 5:
            fields = "".join(f"<label>{self.word()}</label><input name=x>" for _ in range(r.randint(1, 3)))
            return f"<form>{p(self.short())}{fields}<select><option>{self.word()}<option>{self.word()}</select><button>{self.word()}</button></form>"
        if kind in (6, 7):
            many = "".join(
                r.choice((f"<div class=comment><b>{self.word()}</b><p>{self.words(3, 70)}</p></div>", f"<li><p>{self.words(3, 70)}</p></li>", f"<article class=comment><p>{self.words(3, 70)}</p></article>"))
                for _ in range(r.randint(1, 5))
            )
            return self.tag(r.choice(("section", "div", "ol")), f"<h3>{self.short()}</h3>" * (r.random() < 0.6) + many, r.choice(("comments", "comment-list", "discussion", "responses", "replies", "disqus", "comment thread")))
        if kind == 8:
            return self.tag("header", r.choice((f"<h1>{self.short()}</h1>", f"<p>{self.short()}</p>", self.short(), f"<div class=logo>{self.word()}</div>{self.menu()}")), r.choice((None, "site", "page-header")))
        if kind == 9:
            return f"<script>var x = '{self.word()}';</script><style>p{{margin:0}}</style><!-- {self.word()} -->"
        if kind == 10:
            return self.tag("div", self.words(2, 20), r.choice(("header", "masthead", "top", "toolbar", "skip", "login", "pagination", "pager", "tags", "byline share")))
        return self.tag("noscript", self.short())

    def paragraph(self) -> str:
        """Main text, in any of the shapes that it takes."""
        r = self.r
        text = self.words(1, r.choice((4, 12, 40, 120, 250)))
        if r.random() < 0.06:  # tables set as text, formulas, rows of signs
            text = " ".join(x + r.choice((" |", " =", " + ", "~", "***", "&amp;&amp;", " 12.50")) for x in text.split())
        if r.random() < 0.05:
            text = text.upper() + r.choice(("", "!", "!!"))
        kind = r.randrange(20)
        if kind < 9:
            return f"<p>{text}</p>" * (r.choice((2, 3, 6, 12)) if r.random() < 0.06 else 1)
        if kind < 12:
            return f"<p><b>{text}<br><p>{self.words(1, 60)}</p>"
        if kind == 12:
            return f"<p>{self.words(1, 20)} <a href=/x>{self.word()}</a> {text} <em>{self.word()}</em></p>"
        if kind == 13:
            return "<ul>" + "".join(f"<li>{self.words(2, 20)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if kind == 14:
            return f"<h{r.randint(2, 4)}>{self.short()}</h2>"
        if kind == 15:
            return f"<blockquote><p>{text}</p></blockquote>"
        if kind == 16:
            return f"<div>{text}</div>"
        if kind == 17:
            return "<table>" + "".join(f"<tr><td>{self.word()}</td><td>{self.words(1, 5)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>"
        if kind == 18:
            return f"<figure><img src=x><figcaption>{self.short()}</figcaption></figure>" if r.random() < 0.4 else f"<p>{text}"
        return f"<pre>{text}</pre>" if r.random() < 0.3 else f"<p>{text}</p>"

    def page(self) -> list[tuple[str, bool]]:
        """(markup, main?) pieces in page order; the first and last are the frame."""
        r = self.r
        self.lang = r.choice(list(SYLLABLES))
        main_open = r.choice(MAIN) if r.random() < 0.93 else ""
        head = f"<title>{self.short()}</title><style>p{{}}</style>"
        frames = (f"<!DOCTYPE html><html><head>{head}</head><body>",) * 3 + (f"<!doctype html><html><head>{head}", f"<html><head>{head}</head>", f"<html>{head}<body class=page>", head)
        out: list[tuple[str, bool]] = [(r.choice(frames), False)]
        other = self.lang if r.random() < 0.5 else r.choice(list(SYLLABLES))
        own = self.lang

        def noise(p: float, most: int) -> None:
            self.lang = other
            for _ in range(most):
                if r.random() < p:
                    out.append((self.boiler(), False))
            self.lang = own

        if r.random() < 0.8:
            out.append((self.menu(), False))
        noise(0.45, 3)
        out.append((main_open, False))
        if r.random() < 0.8:
            head = f"<h1>{self.short()}</h1>"
            out.append((head, True))
        for _ in range(r.choice((1, 2, 4, 8, 8, 20))):
            out.append((self.paragraph(), True))
            if r.random() < 0.05:
                out.append((self.boiler(), False))
        inside = r.random() < 0.3
        if inside:
            noise(0.4, 2)
        if main_open:
            out.append(("".join(f"</{t.split()[0].strip('<>')}>" for t in reversed(main_open.replace("><", ">\n<").split("\n"))), False))
        noise(0.45, 3)
        if r.random() < 0.85:
            self.lang = other
            foot = f"&copy; {self.word()}.example.com &middot; {self.words(1, 30)}" if r.random() < 0.6 else f"<p>{self.words(2, 40)}</p>" + self.menu() * (r.random() < 0.3)
            out.append((self.tag("footer", foot) if r.random() < 0.75 else self.tag("div", foot, r.choice(("footer", "copyright", "bottom", "legal"))), False))
        out.append(("</body></html>" if r.random() < 0.8 else "", False))
        return out


def labelled(seed: int) -> tuple[list[H.Block], np.ndarray]:
    """A page's blocks and labels: the parser reads the page piece by piece, a block belongs to the piece it began in."""
    parser, labels = H.BlockParser(), []
    began = None
    for markup, main in Pages(seed).page():
        before, open_text = len(parser.blocks), "".join(parser.pieces).strip()
        if not open_text:
            began = main
        parser.feed(markup)
        new = len(parser.blocks) - before
        if new:
            labels += [began] + [main] * (new - 1)
            began = main
        elif "".join(parser.pieces).strip() and not open_text:
            began = main
    parser.close()
    n = len(parser.blocks)
    parser.flush()
    labels += [began] * (len(parser.blocks) - n)
    return parser.blocks, np.array(labels, np.float32)


def _pad(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = max(len(y) for _, y in rows)
    x = np.zeros((len(rows), n, H.WIDTH), np.float32)
    y, mask = np.zeros((len(rows), n), np.float32), np.zeros((len(rows), n), np.float32)
    for i, (a, b) in enumerate(rows):
        x[i, : len(b)], y[i, : len(b)], mask[i, : len(b)] = a, b, 1
    return x, y, mask


def _lstm_grad(dh_out: np.ndarray, x: np.ndarray, keep: list, w: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, ...]:
    """Gradients of one direction: (dx, dw, du, db)."""
    pages, steps, _ = x.shape
    hidden = u.shape[0]
    dz = np.zeros((pages, steps, 4 * hidden), np.float32)
    du = np.zeros_like(u)
    dh, dc = np.zeros((pages, hidden), np.float32), np.zeros((pages, hidden), np.float32)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g, tc, m = keep[t]
        dh = dh + dh_out[:, t]
        d = dh * m
        dct = dc * m + d * o * (1 - tc**2)
        z = dz[:, t]
        z[:, :hidden] = dct * g * i * (1 - i)
        z[:, hidden : 2 * hidden] = dct * c * f * (1 - f)
        z[:, 2 * hidden : 3 * hidden] = d * tc * o * (1 - o)
        z[:, 3 * hidden :] = dct * i * (1 - g**2)
        du += h.T @ z
        dc = dct * f + dc * (1 - m)
        dh = z @ u.T + dh * (1 - m)
    return dz @ w.T, np.einsum("pti,ptj->ij", x, dz, optimize=True), du, dz.sum((0, 1))


def train(pages: int = 4000, rounds: int = 8, batch: int = 32, rate: float = 4e-3, seed: int = 1) -> tuple[dict[str, np.ndarray], float]:
    """Fit; returns the weights and the share of right labels on pages that were not seen."""
    rng = np.random.default_rng(seed)
    data = [(H.vectors(b), y) for b, y in map(labelled, range(pages + pages // 5)) if len(b)]
    data, held = data[:pages], data[pages:]
    init = lambda a, b: (rng.normal(size=(a, b)) / np.sqrt(a)).astype(np.float32)
    w = {"w0": init(H.WIDTH, EMBED), "b0": np.zeros(EMBED, np.float32), "wo": init(2 * HIDDEN, 1), "bo": np.zeros(1, np.float32)}
    for d in "fb":
        bias = np.zeros(4 * HIDDEN, np.float32)
        bias[HIDDEN : 2 * HIDDEN] = 1
        w |= {f"w{d}": init(EMBED, 4 * HIDDEN), f"u{d}": init(HIDDEN, 4 * HIDDEN), f"b{d}": bias}
    m1, m2, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    total = rounds * (len(data) // batch)
    for _ in range(rounds):
        order = rng.permutation(len(data))
        lengths = np.array([len(data[i][1]) for i in order]) + rng.random(len(order)) * 4
        order = order[np.argsort(lengths)]
        for first in rng.permutation(len(order) // batch):
            x, y, mask = _pad([data[i] for i in order[first * batch : (first + 1) * batch]])
            x = x * (rng.random(x.shape) > 0.06)  # names and words may be missing
            x[:, :, H.N_PATH : H.N_PATH + H.N_WORD] *= rng.random((len(x), 1, 1)) > 0.5
            e = np.tanh(x @ w["w0"] + w["b0"])
            kf: list = []
            kb: list = []
            hf = H.lstm(e, mask, w["wf"], w["uf"], w["bf"], kf)
            hb = H.lstm(e[:, ::-1], mask[:, ::-1], w["wb"], w["ub"], w["bb"], kb)[:, ::-1]
            h = np.concatenate([hf, hb], axis=2)
            p = H._sigmoid(h @ w["wo"] + w["bo"])[:, :, 0]
            dp = ((p - y) * mask / mask.sum())[:, :, None].astype(np.float32)
            g = {"wo": np.einsum("pti,ptj->ij", h, dp), "bo": dp.sum((0, 1))}
            dh = dp @ w["wo"].T
            de, g["wf"], g["uf"], g["bf"] = _lstm_grad(dh[:, :, :HIDDEN], e, kf, w["wf"], w["uf"])
            de2, g["wb"], g["ub"], g["bb"] = _lstm_grad(dh[:, ::-1, HIDDEN:], e[:, ::-1], kb, w["wb"], w["ub"])
            da = (de + de2[:, ::-1]) * (1 - e**2)
            g["w0"], g["b0"] = np.einsum("pti,ptj->ij", x, da, optimize=True), da.sum((0, 1))
            step += 1
            lr = rate * 0.5 * (1 + np.cos(np.pi * step / (total + 1)))
            norm = np.sqrt(sum((v**2).sum() for v in g.values()))
            for k in w:
                v = g[k] * min(1.0, 1.0 / (norm + 1e-9))
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.999 * m2[k] + 0.001 * v**2
                w[k] = (w[k] - lr * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    model = H.Labeller(w)
    right = [np.mean(got == (y > 0.5)) for got, (_, y) in zip(model.label([x for x, _ in held]), held)]
    return w, float(np.mean(right))


if __name__ == "__main__":
    weights, accuracy = train()
    out = sys.argv[1] if len(sys.argv) > 1 else __file__.replace("html_train.py", "html_weights.npz")
    np.savez_compressed(out, **weights)
    print(f"right labels on unseen pages: {accuracy:.4f}; written to {out}")
