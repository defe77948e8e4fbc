"""The job runner: pack a folder as the original tool would."""

import glob
import json
import os

from corpuspack.__main__ import main
from models import model_bundle


def test_pack_tree_from_the_command_line(spark, tmp_dir, capsys):
    root = os.path.join(tmp_dir, "proj")
    os.makedirs(os.path.join(root, "src"))
    os.makedirs(os.path.join(root, "__pycache__"))
    open(os.path.join(root, "src", "a.py"), "w").write("# c\nx = 1\n")
    open(os.path.join(root, "src", "b.md"), "w").write("text\n")
    open(os.path.join(root, "__pycache__", "c.py"), "w").write("hidden\n")
    out = os.path.join(tmp_dir, "out")
    main(["pack", "--tree", root, "--out", out, "--select", "--ignore", "--strip-comments"])
    summary = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    parts = sorted(glob.glob(os.path.join(out, "bundle=proj", "part-*")))
    text = "".join(open(p).read() for p in parts)
    assert text == model_bundle("proj", [("src/a.py", "# c\nx = 1\n")], comments=True)[0]
    assert summary == {"bundles": 1, "lines": text.count("\n") + 1, "chars": len(text)}


def test_nothing_selected_writes_nothing(spark, tmp_dir, capsys):
    root = os.path.join(tmp_dir, "p2")
    os.makedirs(root)
    open(os.path.join(root, "a.md"), "w").write("x")
    out = os.path.join(tmp_dir, "out2")
    main(["pack", "--tree", root, "--out", out, "--select"])
    assert "nothing written" in capsys.readouterr().out
    assert not os.path.exists(out)


def test_export_is_one_file(spark, tmp_dir, capsys):
    root = os.path.join(tmp_dir, "my proj")
    os.makedirs(root)
    files = [(f"f{i:02d}.py", f"x = {i} é\n") for i in range(30)]
    for name, text in files:
        open(os.path.join(root, name), "w", encoding="utf-8").write(text)
    out, to = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "one.txt")
    main(["pack", "--tree", root, "--out", out, "--select"])
    assert len(glob.glob(os.path.join(out, "bundle=*", "part-*"))) > 1
    main(["export", "--out", out, "--bundle", "my proj", "--to", to])
    text = open(to, encoding="utf-8", newline="").read()
    assert text == model_bundle("my proj", files)[0]
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"bytes": len(text.encode())}


def test_a_watch_in_parts_takes_all_changes_of_a_poll(spark, tmp_dir, capsys):
    root = os.path.join(tmp_dir, "proj")
    os.makedirs(root)
    files = {f"f{i:02d}.py": f"x = {i}\n" for i in range(12)}

    def put():
        for name, text in files.items():
            open(os.path.join(root, name), "w", encoding="utf-8").write(text)

    put()
    out, state, to = (os.path.join(tmp_dir, n) for n in ("store", "state", "one.txt"))
    args = ["watch", "--tree", root, "--out", out, "--state", state, "--select", "--parts", "--files-per-part", "3", "--once"]

    def exported():
        main(["export", "--out", out, "--bundle", "proj", "--to", to, "--parts"])
        return open(to, encoding="utf-8", newline="").read()

    main(args)
    assert exported() == model_bundle("proj", sorted(files.items()))[0]
    files["f03.py"], files["new.py"], files["notes.md"] = "changed and longer\n", "new\n", "not selected\n"
    os.remove(os.path.join(root, "f07.py"))
    del files["f07.py"]
    put()
    main(args)
    assert exported() == model_bundle("proj", sorted(x for x in files.items() if x[0].endswith(".py")))[0]
