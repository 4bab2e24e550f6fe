"""Digests of files of any size."""

from hashlib import sha256

from tripweave.sources import checksums


def statuses(frame):
    return sorted((r.file, r.status) for r in frame.collect())


def test_tree_finds_changed_and_new_files(spark, tmp_path):
    folder = tmp_path / "raw"
    (folder / "sub dir").mkdir(parents=True)
    texts = {"a": b"1", "b": b"x" * 10, "sub dir/c": bytes(range(256)) * 5, "d": b"12345678"}
    for name, text in texts.items():
        (folder / name).write_bytes(text)
    (folder / "_SUCCESS").write_bytes(b"")
    whole = {r.file: (r.digest, r.length) for r in checksums.file_digests(spark, str(folder)).collect()}
    assert whole == {n: (sha256(t).hexdigest(), len(t)) for n, t in texts.items()}
    roots = {r.file: r.root for r in checksums.tree_digests(spark, str(folder), 8).collect()}
    for name, text in texts.items():
        ranges = [text[i : i + 8] for i in range(0, len(text), 8)] or [b""]
        assert roots[name] == sha256("".join(sha256(r).hexdigest() for r in ranges).encode()).hexdigest()
    checksums.write_tree_digests(spark, str(folder), str(tmp_path / "tree"), 8)
    (folder / "b").write_bytes(b"x" * 9 + b"y")
    (folder / "e").write_bytes(b"new")
    assert statuses(checksums.verify_tree_digests(spark, str(folder), str(tmp_path / "tree"))) == [
        ("a", "OK"), ("b", "FAIL"), ("d", "OK"), ("e", "MISSING"), ("sub dir/c", "OK"),
    ]


def test_file_above_two_gigabytes(spark, tmp_path):
    """Sparse, so it takes no disk; a row of so many bytes is more than Spark can hold."""
    folder = tmp_path / "raw"
    folder.mkdir()
    size = (2 << 30) + 5
    with open(folder / "big", "wb") as f:
        f.seek(size - 1)
        f.write(b"\1")
    row = checksums.tree_digests(spark, str(folder), 256 << 20).first()
    zeros, last = sha256(bytes(256 << 20)).hexdigest(), sha256(b"\0\0\0\0\1").hexdigest()
    assert (row.length, row.root) == (size, sha256((zeros * 8 + last).encode()).hexdigest())
    want = sha256()
    for _ in range(8):
        want.update(bytes(256 << 20))
    want.update(b"\0\0\0\0\1")
    assert checksums.file_digests(spark, str(folder)).first().digest == want.hexdigest()


def test_listing_does_not_read_the_bytes(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"x")
    plan = checksums.listed(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in plan
