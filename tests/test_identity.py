import hashlib
import uuid

from pyspark.sql import functions as F

from tidemark.functions import display as D
from tidemark.functions import identity as I
from tidemark.functions import paths as P


def test_hashes(evaluate):
    text = "hello world\n\nline2"
    digest = "4c43eef4f8cf5af06dcc7520054d0b762c64a6a53ce90fe570214a39199aa90f"
    assert evaluate(I.content_hash, [text, "é😀"]) == [
        digest,
        hashlib.sha256("é😀".encode()).hexdigest(),
    ]
    made = evaluate(lambda c: I.document_id(F.lit("/tmp/sample.txt"), c), [digest])
    assert made == ["7e24c4c7ef104a947e322a63680639f216fffbd3a28a29033b7349876286295b"]


def test_point_ids_are_uuid5(evaluate):
    names = ["test_id", ""] + [f"chunk {i}" for i in range(500)]
    found = evaluate(I.point_id, names)
    assert found == [str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names]
    assert found[0] == "89d1eeb1-162d-5567-9d0c-099a32fbd607"


def test_counts(evaluate):
    texts = ["", "a", "a\nb", "é😀\n", "\n\n"]
    assert evaluate(I.char_count, texts) == [len(t) for t in texts]
    assert evaluate(I.line_count, texts) == [t.count("\n") + bool(t) for t in texts]


def test_paths(evaluate):
    paths = ["/a/b.TXT", "/a/b.tar.md", "/a/.txt", "/a/b.", "/a.b/c", "x.HTM", "/a/..pdf", "/a/b.csv"]
    suffixes = [".txt", ".md", "", "", "", ".htm", ".pdf", ".csv"]
    assert evaluate(P.file_suffix, paths) == suffixes
    assert evaluate(P.file_name, paths)[:2] == ["b.TXT", "b.tar.md"]
    kinds = evaluate(lambda c: P.source_kind(c, strict=False), paths)
    assert kinds == ["txt", "md", None, None, None, "html", "pdf", None]
    assert evaluate(P.mime_type, ["a.md", "a.zzz"]) == ["text/markdown", "application/octet-stream"]


def test_unknown_suffix_raises(evaluate):
    import pytest

    with pytest.raises(Exception, match="Unsupported file type for /a/b.csv. Supported suffixes: .htm, .html"):
        evaluate(P.source_kind, ["/a/b.csv"])


def python_size(n):
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024:
            return f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} TB"


def test_human_size(evaluate):
    sizes = [0, 1023, 1024, 1280, 1792, 1536, 10**6, 1024**2, 1024**2 - 1, 5 * 1024**3, 3 * 1024**4, 7 * 1024**5]
    found = evaluate(lambda c: D.human_size(c.cast("long")), [str(s) for s in sizes])
    assert found == [python_size(s) for s in sizes]
    assert [D.human_size_of(s) for s in sizes] == found


def test_score_bands(evaluate):
    scores = ["0.9", "0.8", "0.51", "0.5", "-1"]
    assert evaluate(lambda c: D.score_band(c.cast("double")), scores) == [
        "green", "yellow", "yellow", "red", "red",
    ]
    assert evaluate(D.short_id, ["0123456789abcdef99"]) == ["0123456789abcdef..."]
