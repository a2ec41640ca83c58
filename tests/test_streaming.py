"""The index follows a stream of files."""

import os

from sparkweave.api import _index
from sparkweave.streaming.reindex import keep_indexed


def test_index_follows_files(spark, tmp_path):
    root, check = str(tmp_path / "tree"), str(tmp_path / "check")
    os.makedirs(root)

    def put(name, text):
        with open(os.path.join(root, name), "w") as f:
            f.write(text)

    put("a.py", "def f():\n    pass\n")
    keep_indexed(spark, root, check, once=True).awaitTermination()
    assert {r["qualified_name"] for r in _index(spark, root).read("nodes").collect()} == {"a.f"}
    put("b.py", "from a import f\ndef main():\n    f()\nif __name__ == '__main__':\n    main()\n")
    put("note.txt", "nothing")
    keep_indexed(spark, root, check, once=True).awaitTermination()
    assert {r["path"] for r in _index(spark, root).read("files").collect()} == {"a.py", "b.py"}
    assert _index(spark, root).read("warnings").count() == 0
    os.unlink(os.path.join(root, "b.py"))  # a file that is gone makes a batch too
    keep_indexed(spark, root, check, once=True).awaitTermination()
    assert {r["path"] for r in _index(spark, root).read("files").collect()} == {"a.py"}
