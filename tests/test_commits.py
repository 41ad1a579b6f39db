"""Commits read from loose and packed objects give what a walk of the working tree gives."""

import os
import random
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from tidemark.sources import commits, repos

pytestmark = pytest.mark.skipif(shutil.which("git") is None, reason="no version control to make a repository with")


def run(path, *args):
    env = {"GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@b", "GIT_CONFIG_GLOBAL": os.devnull, "GIT_CONFIG_SYSTEM": os.devnull, "HOME": str(path), "PATH": os.environ["PATH"]}
    return subprocess.run(["git", "-C", str(path), *args], check=True, capture_output=True, text=True, env=env).stdout.strip()


def put(root, name, text):
    (root / name).parent.mkdir(parents=True, exist_ok=True)
    (root / name).write_bytes(text if isinstance(text, bytes) else text.encode())


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    """Three commits: the first two packed with deltas, the third loose; texts that change a little, odd files, links."""
    root, r = tmp_path_factory.mktemp("work"), random.Random(7)
    run(root, "init", "-q", "-b", "main")
    long = [" ".join(r.choice("abcdefgh") * r.randint(1, 9) for _ in range(12)) for _ in range(400)]
    for i in range(12):
        long[r.randrange(400)] = f"changed {i}"
        put(root, f"src/part{i}.py", "\n".join(long))
    put(root, "big.txt", "x" * 3_000_000)
    put(root, "win.txt", "a\r\nb\rc\n")
    put(root, "odd.txt", b"\xff\xfe bad \xe9")
    put(root, "é/ü.md", "text")
    put(root, "empty.py", "")
    put(root, "node_modules/x.js", "hidden")
    put(root, ".env.local", "secret")
    os.symlink("win.txt", root / "link.txt")
    run(root, "add", "-f", ".")
    run(root, "commit", "-qm", "one")
    run(root, "tag", "-a", "v1", "-m", "first")
    for i in range(12):
        text = (root / f"src/part{i}.py").read_text()
        put(root, f"src/part{i}.py", text.replace("changed 3", f"again {i}") + "\nend")
    run(root, "commit", "-qam", "two")
    run(root, "repack", "-q", "-a", "-d", "--depth=20", "--window=20")
    run(root, "pack-refs", "--all")
    put(root, "src/deep/er/new.py", "print(1)\n")
    put(root, "big.txt", "y" * 2_100_000)
    run(root, "add", ".")
    run(root, "commit", "-qm", "three")
    run(root, "remote", "add", "origin", "https://example.org/shop.git")
    return root


def rows(df):
    return sorted((x["repo"], x["rel"], x["size"], x["text"], x["walk_ord"]) for x in df.collect())


def walk(spark, root, name="w"):
    """The working tree without the store itself."""
    return rows(repos.read_repo(spark, str(root), name))


def test_a_commit_is_its_working_tree(spark, tree):
    stored = run(tree, "count-objects", "-v")
    assert "in-pack: 0" not in stored and not stored.startswith("count: 0")
    got = rows(commits.read_commit(spark, str(tree), "main", "w"))
    assert got == walk(spark, tree) and len(got) == 18
    assert {x[1]: x[3] for x in got}["win.txt"] == "a\nb\nc\n" and {x[1]: x[3] for x in got}["big.txt"] is None


def test_pins(spark, tree, tmp_path):
    first, third = run(tree, "rev-list", "--max-parents=0", "HEAD"), run(tree, "rev-parse", "HEAD")
    assert third in os.listdir(tree / ".git" / "objects" / third[:2])[0] or (tree / ".git" / "objects" / third[:2] / third[2:]).exists()
    store = commits.Store(str(tree))
    assert {store.commit(p).hex() for p in (first, first[:9].upper(), "v1", "refs/tags/v1", "tags/v1")} == {first}
    assert {store.commit(p).hex() for p in ("HEAD", "main", third[:7], third)} == {third}
    run(tree, "worktree", "add", "-q", str(tmp_path / "old"), "v1")
    want = [x[:4] for x in walk(spark, tmp_path / "old") if x[1] != ".git"]  # which tells where the store is
    assert [x[:4] for x in rows(commits.read_commit(spark, str(tree), "v1", "w"))] == want
    assert [x[:4] for x in rows(commits.read_commit(spark, str(tmp_path / "old"), "HEAD", "w"))] == want
    run(tree, "worktree", "remove", "--force", str(tmp_path / "old"))


def test_bare_and_borrowing_stores(spark, tree, tmp_path):
    run(tmp_path, "clone", "-q", "--bare", str(tree), str(tmp_path / "bare.git"))
    run(tmp_path, "clone", "-q", "--shared", "--no-checkout", str(tree), str(tmp_path / "shared"))
    want = walk(spark, tree)
    assert rows(commits.read_commit(spark, str(tmp_path / "bare.git"), "main", "w")) == want
    assert rows(commits.read_commit(spark, str(tmp_path / "shared"), "main", "w")) == want
    assert {x["repo"] for x in commits.read_commit(spark, str(tmp_path / "bare.git")).collect()} == {"bare"}


def test_subfolders_and_shares(spark, tree, monkeypatch):
    monkeypatch.setattr(commits, "PATHS_A_PART", 3)
    got = rows(commits.read_commit(spark, str(tree), "HEAD", "w", "src"))
    assert [x[1:4] for x in got] == [x[1:4] for x in walk(spark, tree) if x[1].startswith("src/")]
    with pytest.raises(Exception, match="no folder"):
        commits.read_commit(spark, str(tree), "HEAD", "w", "nowhere").collect()


@pytest.mark.parametrize("pin", ["nothing", "--all", "../../etc/passwd", "0" * 40, "abcdef0", ""])
def test_unknown_pins_are_errors(spark, tree, pin):
    with pytest.raises(Exception, match="no commit|isn't in the store|is no commit"):
        commits.read_commit(spark, str(tree), pin).collect()


def test_all_objects_of_packs_have_their_names(tree):
    """Every packed object, delta or not, hashes to its name."""
    import hashlib

    store = commits.Store(str(tree))
    n = 0
    for pack in store.all_packs():
        for i in range(pack.n):
            kind, body = store.read(pack.name(i))
            assert hashlib.sha1(f"{kind} {len(body)}\0".encode() + body).digest() == pack.name(i)
            n += 1
    assert n > 20


def test_origin(tree, tmp_path):
    assert commits.origin(str(tree)) == ("https://example.org/shop.git", run(tree, "rev-parse", "HEAD"))
    assert commits.origin(str(tmp_path)) == (None, None)


def test_addresses(spark):
    good = ["https://a.b/c.git", "git@host:me/x.git", "git://h/x", "ssh://git@h/x", "file:///srv/x", "http://a/b"]
    bad = ["-x", "--upload-pack=x", "ext::sh -c x", "https://a b", "$(x)", "", None, "/srv/x", "me@host:x", "file://x"]
    got = spark.createDataFrame([(x,) for x in good + bad], "a string").select("a", commits.safe_address(F.col("a")).alias("ok")).collect()
    assert [x["a"] for x in got if x["ok"]] == good
