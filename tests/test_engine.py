"""Configuration, names, extraction, plans, questions and clustering."""

from __future__ import annotations

import io
import json
import struct
import tarfile
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sortwright import config as C
from sortwright import models as M
from sortwright.functions import names, sniff, text, vectors
from sortwright.operators import cascade, cluster, metrics, rank, rules
from sortwright.plans import plan as P
from sortwright.plans import questions as Q
from sortwright.sources import extract as X
from sortwright.sources import stores


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# Configuration


def test_defaults_and_fingerprint():
    a, b = C.load(), C.load()
    assert len(a.categories) == 12 and a.strategy.margin == 0.04 and a.min_confidence == 0.55
    assert a.fingerprint() == b.fingerprint() != a.fingerprint([("x", "y", "z")])
    b.strategy.margin = 0.05
    assert a.fingerprint() != b.fingerprint()
    assert a.owned == {"Home", "Money", "Work", "Leisure", "_Review"}


@pytest.mark.parametrize(
    "bad",
    [
        {}, {"category": [{"path": "A"}, {"path": "A"}]}, {"category": [{"path": "A"}], "rule": [{"match": "*"}]}, {"category": [{"path": "A"}], "strategy": {"shortlist": 1}},
        {"category": [{"path": "A"}], "strategy": {"mode": "x"}}, {"category": [{"path": "A"}], "model": {"backend": "x"}}, {"category": [{"path": "A"}], "organize": {"when_unsure": "x"}},
    ],
)
def test_settings_are_checked(bad):
    with pytest.raises(ValueError):
        C.parse(bad)


def test_taxonomy_edits_keep_comments(tmp_path):
    p = tmp_path / "c.toml"
    p.write_text('# mine\n[[category]]\npath = "A/B"\ndescription = "x"\n\n# rules follow\n', encoding="utf-8")
    C.add_categories(p, [C.Category("Work/Pay \"slips\"", "wages")])
    assert "# mine" in p.read_text() and "# rules follow" in p.read_text() and p.with_suffix(".toml.bak").exists()
    assert C.load(p).paths == ["A/B", 'Work/Pay "slips"']
    with pytest.raises(ValueError):
        C.add_categories(p, [C.Category("../x")])
    C.remove_category(p, "A/B")
    with pytest.raises(ValueError):
        C.remove_category(p, "A/B")
    assert "# rules follow" in p.read_text()
    C.replace_categories(p, [C.Category("N/M", "n")])
    assert C.load(p).paths == ["N/M"] and "# mine" in p.read_text()


@pytest.mark.parametrize("url,place", [("http://localhost:1", "device"), ("http://127.0.0.1", "device"), ("http://[::1]:2", "device"), ("http://192.168.1.5", "network"), ("http://nas.local", "network"), ("https://api.example.com", "remote"), ("http://8.8.8.8", "remote")])
def test_locality(spark, url, place):
    assert names.locality(url) == place == one(spark, names.locality_of(F.lit(url)))


def test_offline_guard():
    cfg = C.load()
    cfg.model.url = "https://api.example.com"
    with pytest.raises(C.OfflineError):
        M.make_backend(cfg)
    cfg.model.allow_remote = True
    assert M.make_backend(cfg)
    assert C.vision_mode(True) == "on" and C.vision_mode("No") == "off" and C.vision_mode("?") == "auto"


# Columns


def test_names(spark):
    rows = spark.createDataFrame([("A.TXT",), (".bashrc",), ("x.tar.gz",), ("none",), ("dot.",)], "name string")
    assert [r[0] for r in rows.select(names.suffix(F.col("name"))).collect()] == [".txt", "", ".gz", "", ""]
    assert [r[0] for r in rows.select(names.matches(F.col("name"), ["*.txt", "[.x]*"])).collect()] == [True, True, True, False, False]
    assert one(spark, names.clean_path(F.lit("home stuff/McDonald!!/deep"))) == "Home Stuff/McDonald"
    assert one(spark, names.valid_path(F.lit("a/../b"))) is False


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, vectors.cosine(v(0, 0), v(1, 2))) == 0.0
    assert one(spark, vectors.cosine(v(1, 2, 9), v(2, 4))) == pytest.approx(10 / (86**0.5 * 20**0.5))
    assert one(spark, vectors.unit(v(0, 0))) == [0.0, 0.0]


def test_text(spark):
    assert one(spark, text.squash(F.lit("  a \t b\n \n\n c "))) == "a b\n c"
    assert one(spark, text.strip_tags(F.lit("<p>a &lt;b&gt;</p><script>x</p></script>c"))).split() == ["a", "<b>", "c"]
    assert one(spark, text.meter(F.lit(0.5))) in ("●●○○○", "●●●○○")


@pytest.mark.parametrize(
    "head,label",
    [
        (b"%PDF-1.4", "pdf"), (b"\xff\xd8\xff\xe0", "jpeg"), (b"\0\0\0\x18ftypheic", "heic"), (b"\0\0\0\x18ftypisom", "video"), (b"\0\0\0\x18ftypM4A ", "audio"), (b"RIFF....WEBP", "webp"), (b"RIFF....WAVE", "audio"),
        (b"7z\xbc\xaf\x27\x1c", "archive"), (b"SQLite format 3\0", "sqlite"), (b"{\\rtf1", "rtf"), (b"hello there", "text"), (b"true story", "font"), (b"MZ\x90", "windows-program"), (b"a\0b", "binary"),
        (b"\xef\xbb\xbf <!DOCTYPE HTML><html>", "html"), (b"From: a@b\nSubject: hi\n\nx", "email"), (b"x" * 257 + b"ustar", "tar"),
    ],
)
def test_sniff(spark, head, label):
    assert one(spark, sniff.sniff(F.lit(bytearray(head)), F.lit("x"), F.lit(bytearray(b"")))) == label == sniff.label_of(head, "x")


def test_image_sizes():
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 1170, 2532)
    gif = b"GIF89a" + struct.pack("<HH", 5, 300)
    assert X.image_size(png, "png") == (1170, 2532) and X.image_size(gif, "gif") == (5, 300) and X.image_size(png[:20], "png") is None
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 20, 10) + b"\0" * 20
    assert X.image_size(jpeg, "jpeg") == (10, 20)


# Files


def test_formats(tmp_path):
    def put(name, data):
        p = tmp_path / name
        p.write_bytes(data)
        return X.File(str(p))

    def zipped(**members):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            for name, body in members.items():
                z.writestr(name, body)
        return buffer.getvalue()

    w = 'xmlns:w="urn:w"'
    docx = put("a.docx", zipped(**{"word/document.xml": f"<w:d {w}><w:p><w:t>Lease</w:t></w:p><w:p><w:t>terms</w:t></w:p></w:d>"}))
    assert X.parse(docx, "zip") == X.Found("Lease\nterms", "Word document")
    xlsx = put("a.xlsx", zipped(**{"xl/workbook.xml": "<w/>", "xl/sharedStrings.xml": "<s><si><t>rent</t></si></s>", "xl/worksheets/sheet1.xml": '<x><row><c t="s"><v>0</v></c><c><v>12</v></c></row></x>'}))
    assert X.parse(xlsx, "zip").text == "rent, 12"
    book = put("a.epub", zipped(**{"mimetype": "application/epub+zip", "c.opf": "<dc:title>T</dc:title><dc:creator>Ann</dc:creator>", "p.xhtml": "<p>body</p>"}))
    assert "Author: Ann" in X.parse(book, "zip").text and X.parse(book, "zip").kind == "EPUB ebook"
    plain = put("a.zip", zipped(**{"x.txt": "1", "y.txt": "2", "z": "3"}))
    assert X.parse(plain, "zip").text.startswith("Contains: .txt×2, (none)×1\nFiles: x.txt")
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:gz") as t:
        info = tarfile.TarInfo("in/side.csv")
        info.size = 1
        t.addfile(info, io.BytesIO(b"1"))
    assert "side.csv" in X.parse(put("a.tgz", tar.getvalue()), "tar").text
    assert not X.parse(put("a.gz", b"\x1f\x8bxxxx"), "tar").readable
    assert "hello" in X.parse(put("m.eml", b"Subject: S\nFrom: a@b\nTo: c@d\n\nhello\n"), "email").text
    page = X.parse(put("p.html", b"<html><title>T</title><script>no</script><p>yes"), "html").text
    assert "Title: T" in page and "no" not in page and "yes" in page
    frame = lambda i, s: i + struct.pack(">I", len(s) + 1) + b"\0\0\0" + s
    body = frame(b"TIT2", b"Song") + frame(b"TPE1", b"Band")
    mp3 = put("a.mp3", b"ID3\x03\0\0" + bytes([0, 0, 0, len(body)]) + body)
    assert X.parse(mp3, "audio").text == "Title: Song\nArtist: Band" and X.parse(mp3, "audio").readable
    exe = put("a.exe", b"MZ\0\0" + b"Setup Wizard Inc\0\0" + b"\1" * 20)
    assert "Setup Wizard Inc" in X.parse(exe, "windows-program").text and not X.parse(exe, "windows-program").readable
    assert "could not parse" in X.parse(put("b.docx", b"PK\3\4broken"), "zip").kind
    pixels = X.png(4, 3, bytes(36), 3)
    assert X.image_size(pixels, "png") == (4, 3) and zlib.decompress(pixels[pixels.index(b"IDAT") + 4 : -16]) == (b"\0" + bytes(12)) * 3
    assert X.parse(put("Screenshot 1.txt", pixels), "png").kind.endswith("probably a screenshot")
    (tmp_path / "box").mkdir()
    (tmp_path / "box/a.txt").write_text("inside words")
    found = X.folder(str(tmp_path / "box"))
    assert "1 files" in found.text and "inside words" in found.text


# Cascade


def ranked_rows(spark, rows):
    kind = "id int, ranked array<struct<category:string,score:double>>, readable boolean, image binary"
    return spark.createDataFrame(rows, kind)


def test_decision_table(spark):
    top = lambda a, b: [("A", a), ("B", b), ("C", 0.0)]
    rows = ranked_rows(spark, [(1, top(0.9, 0.1), True, None), (2, top(0.5, 0.49), True, None), (3, top(0.9, 0.1), False, None), (4, top(0.9, 0.1), True, bytearray(b"i")), (5, top(0.5, 0.49), True, None), (6, top(0.5, 0.49), True, None)])
    near = F.array(F.struct(F.lit(1).alias("seq"), F.lit("A").alias("category"), F.lit(0.9).alias("score")))
    answers = {2: "A", 3: "A", 4: "B", 5: "B", 6: "nothing"}
    asked = []

    def choose(r):
        asked.append(r.count())
        reply = F.create_map(*[x for k, v in answers.items() for x in (F.lit(k), F.lit(json.dumps({"reason": "r", "category": v})))])
        return r.withColumn("picked", cascade.parse_choice(reply[F.col("id")], F.col("choices")))

    s = cascade.Settings(tau=0.62)
    out = cascade.finish(cascade.decide(rows.withColumn("nearest", near), ["A", "B", "C"], s, choose, lambda df, n: df), "A").collect()
    got = {r["id"]: (r["category"], r["confidence"], r["via"], r["review"]) for r in out}
    assert got == {1: ("A", 0.9, "embed", False), 2: ("A", 0.8, "llm", False), 3: ("A", 0.8, "llm", False), 4: ("B", 0.7, "vision", False), 5: ("B", 0.6, "llm", False), 6: ("A", 0.0, "llm", True)}
    assert asked == [5]
    embed = cascade.finish(cascade.decide(rows, ["A", "B", "C"], cascade.Settings("embed"), choose, lambda df, n: df), "A").collect()
    assert {r["id"]: r["confidence"] for r in embed} == {1: 0.9, 2: 0.5, 3: 0.2, 4: 0.5, 5: 0.5, 6: 0.5}
    plain = cascade.decide(rows, ["A", "B", "C"], cascade.Settings("llm"), choose, lambda df, n: df).where("id = 2").first()
    assert plain["confidence"] == 0.7
    with pytest.raises(ValueError):
        cascade.Settings(shortlist=1)


def test_parse_choice(spark):
    choices = F.array(F.lit("Finance/Taxes"), F.lit("Study"))
    for reply, want in [('{"category": "finance / taxes"}', "Finance/Taxes"), ('I think {"category": "Study"} fits', "Study"), ('{"category": "Other"}', None), ("none", None)]:
        assert one(spark, cascade.parse_choice(F.lit(reply), choices)["category"]) == want


def test_one_example_leaves_others_alone(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 0.0, 1.0])], "id int, vec array<double>")
    cats = spark.createDataFrame([(0, "A", [1.0, 0.1, 0.0]), (1, "B", [0.0, 1.0, 1.0])], "ord int, category string, vec array<double>")
    examples = spark.createDataFrame([(0, "B", [1.0, 0.0, 0.0])], "seq int, category string, vec array<double>")
    score = lambda df: {(r["id"], x["category"]): x["score"] for r in df.collect() for x in r["ranked"]}
    before, after = score(rank.ranked(docs, cats)), score(rank.ranked(docs, cats, examples=examples, tau=0.62))
    assert after[1, "B"] == pytest.approx(before[1, "B"] + 0.5 * 0.38) and all(after[k] == before[k] for k in before if k != (1, "B"))
    none = spark.createDataFrame([], "seq int, category string, vec array<double>")
    assert score(rank.ranked(docs, cats, examples=none)) == before
    assert rank.nearest(docs, none, 4).first()["nearest"] == []


def test_one_category_has_a_margin(spark):
    best = F.array(F.struct(F.lit("A").alias("category"), F.lit(0.3).alias("score")))
    assert one(spark, rank.margin(best)) == 0.3


def test_rules_and_samples(spark):
    held = [C.Rule(["*.dmg"], None, "skip"), C.Rule(["inv*", "*.pdf"], "Bills")]
    rows = spark.createDataFrame([("X.DMG",), ("invoice.txt",), ("b.PDF",), ("z",)], "name string")
    assert [r[0] and r[0]["ord"] for r in rows.select(rules.first_rule(F.col("name"), held)).collect()] == [0, 1, 1, None]
    assert sorted(r["id"] for r in rules.even_sample(spark.range(1000), "id", 7).collect()) == [i * 1000 // 7 for i in range(7)]
    words = spark.range(500).select(F.format_string("%05d", "id").alias("w"))
    assert sorted(r["w"] for r in rules.even_sample(words, "w", 3).collect()) == ["00000", "00166", "00333"]


# Clusters


def test_blobs(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (np.eye(3)[i % 3] + rng.normal(0, 0.05, 3)).tolist()) for i in range(18)]
    df = spark.createDataFrame(rows, "id int, vec array<double>")
    found = {r["id"]: r["cluster"] for r in cluster.over_split(df, "id").collect()}
    assert len(set(found.values())) == 6 and all(len({i % 3 for i in found if found[i] == c}) == 1 for c in found.values())
    labels, v = [found[i] for i in range(18)], np.array([r[1] for r in rows])
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    best = sum(max(sum(float(v[a] @ v[b]) for b in range(18) if labels[b] == c) for a in range(18) if labels[a] == c) for c in set(labels))
    withc = df.join(spark.createDataFrame(list(found.items()), "id int, cluster int"), "id")
    assert cluster.objective(withc, "id").first()[0] == pytest.approx(best)
    assert cluster.over_split(df.limit(2), "id").select("cluster").distinct().count() == 1
    with pytest.raises(ValueError):
        cluster.over_split(spark.range(3000).select("id", F.array(F.lit(1.0)).alias("vec")), "id")


# Plans and questions


def test_moves_and_undo(tmp_path):
    home, inbox = tmp_path / "home", tmp_path / "in"
    inbox.mkdir()
    for n in ("a.txt", "b.txt", "c.txt"):
        (inbox / n).write_text(n)
    (home / "X").mkdir(parents=True)
    (home / "X/a.txt").write_text("old")
    items = [{"src": str(inbox / n), "target": str(home / "X" / n)} for n in ("a.txt", "b.txt")] + [{"src": str(inbox / "c.txt"), "target": None}, {"src": str(inbox / "gone"), "target": str(home / "g")}]
    moved, errors = P.apply(items, tmp_path / "j/run.jsonl")
    assert moved == 2 and len(errors) == 1 and (home / "X/a (2).txt").read_text() == "a.txt" and (home / "X/a.txt").read_text() == "old" and (inbox / "c.txt").exists()
    journal = P.latest_journal(tmp_path / "j")
    with pytest.raises(ValueError):
        P.undo(journal, 0)
    assert P.undo(journal, 1) == (1, []) and (inbox / "b.txt").exists() and len(P.Journal(journal).entries()[0]) == 1
    (inbox / "a.txt").write_text("new")
    assert P.undo(journal)[0] == 0 and len(P.Journal(journal).entries()[0]) == 1
    (inbox / "a.txt").unlink()
    assert P.undo(journal) == (1, []) and (inbox / "a.txt").read_text() == "a.txt" and not journal.exists()


def test_report():
    rows = [{"name": "a", "category": "A/B", "review": False, "confidence": 0.9, "reason": "r"}, {"name": "b", "category": "A/B", "review": True, "confidence": 0.5, "reason": ""}, {"name": "c", "category": None, "review": False, "confidence": 1.0, "reason": "rule"}]
    assert P.report(rows).splitlines() == ["A/B", "  a  0.90  r", "(stays)", "  c  1.00  rule", "(unsure)", "  b  0.50", "1 to file, 1 unsure, 1 left"]


def test_questions(spark):
    keys = iter(["x", "a", "2"])
    assert Q.ask(["A"], ["A", "B"], lambda p: next(keys)) == Q.Answer("file", "B")
    keys = iter(["n", "../up", "n", "Work/Pay", ""])
    assert Q.ask(["A"], ["A"], lambda p: next(keys)) == Q.Answer("new", "Work/Pay", "work pay")
    for key, want in [("", Q.Answer("file", "A")), ("s", Q.Answer("leave")), ("q", Q.Answer("quit"))]:
        assert Q.ask(["A"], ["A"], lambda p, k=key: k) == want
    item = lambda c, *alt: one(spark, Q.guesses(F.lit(c).cast("string"), F.array(*[F.lit(a) for a in alt]).cast("array<string>"), ["A", "B", "C", "D"]))
    assert item("B", "X", "B", "A") == ["B", "A"] and item(None, "X") == ["A", "B", "C"]


def test_models():
    bag = M.WordBag(("tax", "trip"))
    assert bag.embed(["Tax tax"]) == [[2.01, 0.01]] and json.loads(bag.choose("", "", ["A", "B"]))["category"] == "B"
    assert M.has_model(bag, "built-in") and not M.has_model(bag, "x")
    h = M.Hashing()
    assert json.loads(h.choose("- A: apples\n- B: pears", "pears here\n\nChoose one of: A, B", ["A", "B"]))["category"] == "B"
    assert M.prefixes("nomic-embed-text")[0] and M.prefixes("x") == ("", "")
    assert M.choice_schema(["A"])["properties"]["category"]["enum"] == ["A"] and list(M.choice_schema(["A"])["properties"]) == ["reason", "category"]


def test_leave_one_out_of_many_labels(spark):
    rows = spark.range(41_000).select("id", F.floor(F.col("id") / 2).alias("label"))
    found = metrics.leave_one_out(rows, "id", "label", 2)
    assert found.count() == 41_000 and found.where("example <> id + 1 - 2 * (id % 2)").count() == 0


def test_sides_are_not_cut(spark):
    many = spark.range(0, 25_000, 1, 8).select(F.concat(F.lit("n"), "id").alias("category"))
    assert rules.without_owned(many.select(F.col("category").alias("name")), many).count() == 0
    assert stores.live(many, many).count() == 25_000
    held = spark.range(0, 1_200, 1, 8).select(F.col("id").cast("int").alias("ord"), F.concat(F.lit("^r"), "id", F.lit("$")).alias("regex"), F.lit("c").alias("category"), F.lit("move").alias("action"))
    found = rules.first_rule_join(spark.range(1_200).select(F.concat(F.lit("R"), "id").alias("name")), held)
    assert found.where("rule.ord = cast(substring(name, 2) as int)").count() == 1_200


def test_server_errors(tmp_path):
    """Refusals keep what the server said; connections that break are errors of the backend."""
    import socket
    import threading

    def serve(*replies):
        listener = socket.create_server(("127.0.0.1", 0))

        def run():
            for reply in replies:
                c, _ = listener.accept()
                c.recv(4096)
                if reply:
                    c.sendall(reply)
                c.close()

        threading.Thread(target=run, daemon=True).start()
        return f"http://127.0.0.1:{listener.getsockname()[1]}/x"

    with pytest.raises(M.BackendError, match="404.*no such model"):
        M._post(serve(b"HTTP/1.1 404 Not Found\r\nContent-Length: 13\r\n\r\nno such model"), {}, 5)
    for broken in (b"", b"HTTP/1.1 200 OK\r\nContent-Length: 50\r\n\r\n{}", b"nonsense\r\n\r\n", b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc"):
        with pytest.raises(M.BackendError):
            M._post(serve(broken), {}, 5)
    with pytest.raises(M.BackendError):
        M._post("http://127.0.0.1:1/x", {}, 5)
    assert M.thinks("library/Phi4-Reasoning:plus") and M.thinks("my-qwen3-tune") and not M.thinks("phi4")


class Stream(dict):
    """A picture or page of a PDF as its reader gives it."""

    def get_object(self):
        return self

    @property
    def _data(self):
        return self["data"]

    def get_data(self):
        return self["data"]


def test_pdf_pictures():
    from sortwright.sources import pdf

    def page(**streams):
        return {"/Resources": {"/XObject": streams}}

    def picture(width, height, data, filters, space="/DeviceRGB", **more):
        return Stream({"/Subtype": "/Image", "/Width": width, "/Height": height, "data": data, "/Filter": filters, "/ColorSpace": space, **more})

    jpeg = picture(90, 90, b"jpeg", "/DCTDecode")
    assert list(pdf._drawn(page(a=picture(2, 2, bytes(12), "/FlateDecode"), b=jpeg, c=Stream({"/Subtype": "/Form"})))) == [b"jpeg"]
    assert list(pdf._drawn(page(b=picture(9, 9, b"deep", ["/FlateDecode", "/DCTDecode"])))) == [b"deep"]
    grey = next(pdf._drawn(page(a=picture(2, 3, bytes(range(6)), ["/FlateDecode"], "/DeviceGray"))))
    assert X.image_size(grey, "png") == (2, 3) and zlib.decompress(grey[grey.index(b"IDAT") + 4 : -16]) == b"\0\0\1\0\2\3\0\4\5"
    for odd in (picture(2, 2, bytes(11), "/FlateDecode"), picture(2, 2, bytes(12), "/FlateDecode", "/Indexed"), picture(2, 2, bytes(12), "/FlateDecode", **{"/BitsPerComponent": 1}), picture(2, 2, b"", "/JBIG2Decode")):
        assert list(pdf._drawn(page(a=odd))) == []
    assert list(pdf._drawn({})) == []


def test_pdf_pages(monkeypatch):
    from sortwright.sources import pdf

    long = "words of a page " * 5
    read = lambda **k: monkeypatch.setattr(pdf, "READERS", {"none": lambda f: None, "one": lambda f: pdf.Pages(**k)})
    blob = X.Blob("a.pdf", b"%PDF")
    read(text=long, title="A title", number=1)
    assert (X.pdf(blob, True).text, X.pdf(blob, True).kind) == (f"Title: A title\n{long}", "PDF, 1 page")
    read(text=long, title="WORDS of", number=2)
    assert (X.pdf(blob, True).text, X.pdf(blob, True).kind) == (long, "PDF, 2 pages")
    read(locked=True)
    assert X.pdf(blob, True).kind == "password-protected PDF" and not X.pdf(blob, True).readable
    read(text="short", number=4, pictures=iter([b"one", b"two"]))
    scan = X.pdf(blob, True)
    assert scan.kind == "scanned PDF without a text layer, 4 pages" and scan.image == b"one" and scan.readable and scan.has_picture
    read(text="short", pictures=iter([b"one"]))
    assert X.pdf(blob, False).image is None and not X.pdf(blob, False).readable and X.pdf(blob, False).kind.endswith("layer, PDF")
    monkeypatch.setattr(pdf, "READERS", {})
    assert X.pdf(blob, False).kind == "scanned PDF without a text layer, PDF"


def test_tags_of_audio():
    seven = lambda n: bytes((n >> s) & 127 for s in (21, 14, 7, 0))
    frame = lambda name, code, raw: name + seven(len(raw) + 1) + b"\0\0" + bytes([code]) + raw
    body = frame(b"TIT2", 1, "Größe".encode("utf-16")) + frame(b"XXXX", 3, b"skip") + frame(b"TPE1", 3, "Bänd".encode()) + frame(b"TPE1", 3, b"second") + frame(b"TDRC", 9, b"1999\0") + frame(b"TALB", 2, "Álbum".encode("utf-16-be")) + frame(b"TCON", 0, b"\0")
    head = b"ID3\x04\0\0" + seven(len(body) + 20)
    assert X.Id3(head + body + bytes(20)).texts() == {"Title": "Größe", "Artist": "Bänd", "Year": "1999", "Album": "Álbum"}
    assert X.Id3(head + body[:30]).texts() == {"Title": "Größe"} or X.Id3(head + body[:30]).texts() != {}
    assert X.audio(X.Blob("a.mp3", b"ID3")).text == "" and not X.audio(X.Blob("a.mp3", b"\xff\xfb")).readable
