"""Exact round trips of stored payloads; main text of pages whose article is known."""

import hashlib
import html
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq

from svloom.llm import html_text, media


def test_round_trips(monkeypatch):
    rng = np.random.default_rng(0)
    payloads = [b" " * 192, bytes(rng.integers(0, 256, 192 * 7, dtype=np.uint8)), bytes([128]) * 384, bytes([127, 128, 129] * 64 * 5), bytes([128]) * (192 * 9) + bytes([129]) + bytes([128]) * 191, bytes(rng.integers(126, 131, 192 * 40, dtype=np.uint8))]
    payloads += [bytes(rng.choice([128, 129, 127, 140], 192 * 3, p=[0.95, 0.02, 0.02, 0.01]).astype(np.uint8)) for _ in range(100)]
    files = media.written(payloads)
    together = media.decoded(files)
    assert [media.payload_of(*x) for x in together] == payloads
    assert [media.features(media.tensor(*x)) for x in together] == [media.features(media.tensor(*media.decoded([f])[0])) for f in files]
    monkeypatch.setattr(media, "MOST_ROWS", 5)
    large = [bytes(rng.integers(0, 256, 192 * 61, dtype=np.uint8)), b"a" * 192 * 23]
    assert [media.payload_of(*x) for x in media.decoded(media.written(large))] == large


def test_main_text():
    model = html_text.trained()
    right = total = 0
    rng = random.Random(99)
    for page in (html_text.generated(rng) for _ in range(60)):
        scores = model.scores([html_text.vectors([b[:3] for b in page])])[0]
        right += sum((s > 0) == b[3] for s, b in zip(scores, page, strict=True))
        total += len(page)
    assert right / total > 0.97
    for raw in pq.read_table("/root/testdata/sf0.001/pages.parquet").column("html").to_pylist():
        found = html_text.blocks(raw)
        scores = model.scores([html_text.vectors(found)])[0]
        article = re.search("<article>(.*)</article>", raw, re.S)[1]
        expected = " ".join(html.unescape(re.sub("<[^>]*>", "", re.sub(r"<(br|p|h1|/p|/h1)>", " ", article))).split())
        assert " ".join(t for (_, t, _), s in zip(found, scores, strict=True) if s > 0) == expected
    assert html_text.blocks("") == [] and html_text.blocks("<script>x</script><!-- y -->") == []


class Scalar:
    """A progressive JPEG decoder, one bit and one coefficient at a time, for 4:2:0 images."""

    def __init__(self, raw: bytes):
        at, self.restart, self.tables = 2, 0, {}
        while True:
            code, size = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
            body = raw[at + 4 : at + 2 + size]
            at += 2 + size
            if code == 0xC2:
                self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                self.parts = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15) for i in range(body[5])}
                h, v = self.parts[1]
                self.wide, self.tall = -(-self.width // (8 * h)), -(-self.height // (8 * v))
                self.coef = {c: np.zeros((self.tall * y, self.wide * x, 64), int) for c, (x, y) in self.parts.items()}
            elif code == 0xDD:
                self.restart = int.from_bytes(body, "big")
            elif code == 0xC4:
                while body:
                    counts, k, value = body[1:17], 17, 0
                    codes = {}
                    for n, c in enumerate(counts, 1):
                        for _ in range(c):
                            codes[n, value] = body[k]
                            value, k = value + 1, k + 1
                        value <<= 1
                    self.tables[body[0]] = codes
                    body = body[k:]
            elif code == 0xDA:
                end = at
                while not (raw[end] == 0xFF and raw[end + 1] not in (0, *range(0xD0, 0xD8))):
                    end += 1
                self.scan(body, raw[at:end])
                at = end
            if raw[at + 1] == 0xD9:
                return

    def bit(self) -> int:
        self.at += 1
        return self.bits[self.at - 1]

    def number(self, n: int) -> int:
        out = 0
        for _ in range(n):
            out = out << 1 | self.bit()
        return out

    def symbol(self, table: dict) -> int:
        n = value = 0
        while (n, value) not in table:
            n, value = n + 1, value << 1 | self.bit()
        return table[n, value]

    def signed(self, n: int) -> int:
        x = self.number(n)
        return x if not n or x >> n - 1 else x - (1 << n) + 1

    def scan(self, head: bytes, data: bytes) -> None:
        which = [(head[1 + 2 * i], head[2 + 2 * i]) for i in range(head[0])]
        first, last, steps = head[-3:]
        high, low = steps >> 4, steps & 15
        if len(which) > 1:
            units = [[(c, t, y * self.parts[c][1] + j, x * self.parts[c][0] + i) for c, t in which for j in range(self.parts[c][1]) for i in range(self.parts[c][0])] for y in range(self.tall) for x in range(self.wide)]
        else:
            c, t = which[0]
            h, v = self.parts[c]
            top = max(p[0] for p in self.parts.values()), max(p[1] for p in self.parts.values())
            wide, tall = -(-self.width * h // (8 * top[0])), -(-self.height * v // (8 * top[1]))
            units = [[(c, t, y, x)] for y in range(tall) for x in range(wide)]
        pieces = re.split(rb"\xff[\xd0-\xd7]", data)
        step = self.restart or len(units)
        for k, piece in enumerate(pieces):
            self.bits = np.unpackbits(np.frombuffer(piece.replace(b"\xff\x00", b"\xff"), np.uint8)).tolist()
            self.at, run, before = 0, 0, {}
            for unit in units[k * step : (k + 1) * step]:
                for c, t, y, x in unit:
                    block = self.coef[c][y, x]
                    if not first:
                        if high:
                            block[0] |= self.bit() << low
                        else:
                            before[c] = before.get(c, 0) + self.signed(self.symbol(self.tables[t >> 4]))
                            block[0] = before[c] << low
                    elif not high:
                        run = self.first(block, self.tables[16 | t & 15], first, last, low, run)
                    else:
                        run = self.refined(block, self.tables[16 | t & 15], first, last, low, run)

    def first(self, block, table, k, last, low, run) -> int:
        if run:
            return run - 1
        while k <= last:
            r, s = divmod(self.symbol(table), 16)
            if s:
                k += r
                block[k] = self.signed(s) * (1 << low)
                k += 1
            elif r == 15:
                k += 16
            else:
                return (1 << r) - 1 + self.number(r)
        return 0

    def refined(self, block, table, k, last, low, run) -> int:
        def better(i):
            if self.bit():
                block[i] += (1 << low) if block[i] > 0 else -(1 << low)

        if not run:
            while k <= last:
                r, s = divmod(self.symbol(table), 16)
                value = 0
                if s:
                    value = 1 << low if self.bit() else -(1 << low)
                elif r < 15:
                    run = (1 << r) + self.number(r)
                    break
                while k <= last:
                    if block[k]:
                        better(k)
                    elif r:
                        r -= 1
                    else:
                        break
                    k += 1
                if value:
                    block[k] = value
                k += 1
        if run:
            for i in range(k, last + 1):
                if block[i]:
                    better(i)
            run -= 1
        return run

    def payload(self, size: int) -> bytes:
        out = []
        for y in range(self.tall):
            for x in range(self.wide):
                out += [self.coef[1][2 * y + j, 2 * x + i] for j in (0, 1) for i in (0, 1)] + [self.coef[2][y, x], self.coef[3][y, x]]
        return (np.concatenate(out) + 128).astype(np.uint8).tobytes()[:size]

    def rgb(self) -> np.ndarray:
        """All quantisers are 1; chroma pixels are doubled."""
        u = np.arange(8)
        one = np.cos((2 * u[None] + 1) * u[:, None] * np.pi / 16) * np.where(u[:, None] == 0, np.sqrt(1 / 8), 0.5)
        order = sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8))
        planes = {}
        for c, coef in self.coef.items():
            square = np.zeros(coef.shape)
            square[..., order] = coef
            pixels = np.einsum("yxuv,ui,vj->yixj", square.reshape(*coef.shape[:2], 8, 8), one, one) + 128
            pixels = pixels.reshape(coef.shape[0] * 8, coef.shape[1] * 8)
            planes[c] = np.clip(np.round(pixels if c == 1 else pixels.repeat(2, 0).repeat(2, 1)), 0, 255)
        y, b, r = planes[1], planes[2] - 128, planes[3] - 128
        out = np.stack([y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b], -1)
        return np.clip(np.round(out), 0, 255)[: self.height, : self.width]


def test_decoder_against_a_scalar_one():
    rng = np.random.default_rng(3)
    payloads = [b" " * 192, bytes(rng.integers(0, 256, 192 * 3, dtype=np.uint8)), ("Some text é with words. " * 60).encode()[: 192 * 7], bytes(rng.choice([128, 129, 126], 192 * 12, p=[0.9, 0.05, 0.05]).astype(np.uint8))]
    files = media.written(payloads)
    for raw, payload, (image, coef) in zip(files, payloads, media.decoded(files), strict=True):
        slow = Scalar(raw)
        assert slow.payload(len(payload)) == payload == media.payload_of(image, coef)
        fast = media.tensor(image, coef)
        assert fast.shape == slow.rgb().shape and np.abs(fast.astype(int) - slow.rgb()).max() <= 3


def test_media_query(spark):
    texts = [None, "", "a", "é" * 300, "x" * 192, "long " * 20_000, "a", " "]
    df = spark.createDataFrame([(i if i else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, media string").repartition(2)
    got = {r["doc_id"]: r for r in media.described(media.stored(df)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        file = media.written([payload])[0]
        r = got[i if i else None]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(file), hashlib.sha256(file).hexdigest())
        assert r["feature"] == media.features(media.tensor(*media.decoded([file])[0]))
    assert got[2]["feature"] == got[6]["feature"]
    for r in media.tensors(media.stored(df)).collect():
        assert len(r["rgb"]) == 3 * r["height"] * r["width"]
        if r["doc_id"] == 3:
            raw = media.written([("é" * 300).encode() + b" " * 168])[0]
            assert np.abs(np.frombuffer(r["rgb"], np.uint8).reshape(r["height"], r["width"], 3).astype(int) - Scalar(raw).rgb()).max() <= 3
    assert media.described(media.stored(df.limit(0))).count() == 0


def test_extracted_pages(spark):
    article = "".join(f"<p>Paragraph {i} has quite a few words of plain running text in it.</p>" for i in range(8))
    page = f"<html><head><title>T</title></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Head line of it</h1>{article}</article><footer><p>Small print</p></footer></body></html>"
    huge = page.replace("</article>", "<p>One more short paragraph of the article.</p>" * 3000 + "</article>")
    pages = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "v", huge), (None, "w", page), (1, "u", page), (6, "s", "<script>never ends")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, text string").coalesce(1)
    got = html_text.extracted(df).collect()
    assert len(got) == len(pages)
    want = "Head line of it " + " ".join(f"Paragraph {i} has quite a few words of plain running text in it." for i in range(8))
    by = {(r["page_id"], r["url"]): r for r in got}
    assert by[1, "u"]["text"] == by[None, "w"]["text"] == want and by[1, "u"]["n_chars"] == len(want)
    assert by[2, None]["text"] == by[3, "u"]["text"] == by[6, "s"]["text"] == "" and by[3, "u"]["n_chars"] == 0
    assert by[4, "v"]["text"] == want + " One more short paragraph of the article." * 3000
    assert html_text.extracted(df.limit(0)).count() == 0


def test_query_on_pages(spark):
    """The registered query, page by page, against what stands between the article's tags."""
    from svloom.llm.queries import queries

    raw = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    got = queries()["op3_html_text"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(raw) == sorted(r["page_id"] for r in got)
    for r in got:
        article = re.search("<article>(.*)</article>", raw[r["page_id"]], re.S)[1]
        assert r["text"] == " ".join(html.unescape(re.sub("<[^>]*>", "", re.sub(r"<(br|p|h1|/p|/h1)>", " ", article))).split())
        assert r["n_chars"] == len(r["text"])


def test_odd_markup():
    texts = lambda page: [t for _, t, _ in html_text.blocks(page)]
    assert texts('<div title="x>y</div>') == ["y"]
    assert texts('<div title="a>b">y</div>') == ["y"]
    assert texts("<p>one</p><!-- open <p>two</p>") == ["one"]
    assert texts('<p>one</p><svg class="i"/><p>two</p>') == ["one", "two"]
    assert texts("<p>let <math><mi>x</mi></math> be</p>") == ["let x be"]
    assert texts("<p>1 < 2 &amp; 3</p>") == ["1 < 2 & 3"]
    assert texts('<a b="' * 20_000) is not None  # in time
    assert sum(map(len, html_text.together([5000, 3, 0, 4, 20_000, 2]))) == 5
    assert all(len(g) * max(g) <= html_text.CELLS or len(g) == 1 for g in ([[5000, 3, 0, 4, 20_000, 2][i] for i in x] for x in html_text.together([5000, 3, 0, 4, 20_000, 2])))
