"""One session for all tests, and small working trees."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ["PYTHONPATH"] = str(Path(__file__).resolve().parent.parent) + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from repolith.session import get_session

    return get_session("tests", master="local[4]", **{"spark.sql.shuffle.partitions": "4"})


def write(root: Path, files: dict[str, str]) -> str:
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text, encoding="utf-8")
    return str(root)


def lines(n: int, text: str = "step {}") -> str:
    return "".join(text.format(i) + "\n" for i in range(n))


@pytest.fixture(scope="session")
def depot(tmp_path_factory):
    """A warehouse program in six languages of two ecosystems, with folders and files that must not be seen."""
    return write(
        tmp_path_factory.mktemp("t") / "depot",
        {
            ".repolithignore": "# what is private\n\nkeys.env\nplans/draft/\n",
            "LICENSE": "free\n",
            "Cargo.toml": '[package]\nname = "depot"\n',
            "pyproject.toml": '[project]\nname = "depot"\ndependencies = ["Django==2.2.28", "httpx[http2]>=0.27; python_version > \'3.9\'"]\n',
            "engine/main.rs": "fn main() {\n" + lines(35, "    load({});") + "}\n",
            "engine/shelf.rs": lines(13, "// shelf {}"),
            "report/totals.py": lines(25, "total_{} = 0"),
            "report/query.sql": "select 1\n",
            "screen/Panel.vue": "<template><p>shelf</p></template>\n<style></style>\n",
            "screen/package.json": '{"name": "screen"}',
            "deploy": "#!/bin/sh\nset -e\n./engine/main\n",
            "plans/layout.md": "# Layout\n",
            "plans/draft/next.md": "later",
            "keys.env": "PIN=1",
            "target/debug/main.rs": lines(900, "// made {}"),
            "report/__pycache__/totals.pyc": "x",
            "screen/app.min.js": "x",
        },
    )


@pytest.fixture(scope="session")
def traders(tmp_path_factory):
    """Imports between folders in three languages; a file and a folder of one name; places where programs start."""
    return write(
        tmp_path_factory.mktemp("t") / "traders",
        {
            "go.mod": "module trade.test/floor\n\ngo 1.21\n\nrequire (\n\tgithub.com/gin-gonic/gin v1.9.1 // indirect\n)\nrequire gorm.io/gorm v1.25.0\n",
            "gate/main.go": 'package main\n\nimport "fmt"\nimport (\n\t"trade.test/floor/ledger"\n\tq "trade.test/floor/quotes"\n)\n\nfunc main() {\n\tfmt.Println(ledger.Sum(), q.Last())\n}\n',
            "ledger/sum.go": "package ledger\n\nfunc Sum() int { return 0 }\n",
            "quotes.go": "package floor\n",
            "quotes/last.go": 'package quotes\n\nimport "trade.test/floor"\n\nfunc Last() int { return 1 }\n',
            "desk.py": "from flask import Flask\nfrom risk.limits import cap\nimport risk, os\n\napp = Flask(__name__)\nif __name__ == '__main__':\n    app.run(cap())\n",
            "risk/__init__.py": "",
            "risk/limits.py": "from . import rates\nfrom .rates import now\n\ndef cap():\n    return now()\n",
            "risk/rates.py": "def now():\n    return 2\n",
            "package.json": '{"name": "t", "bin": {"quote": "./tools/quote.js"}, "scripts": {"start": "node web", "lint": "x"}, "dependencies": {"react": "17.0.2", "koa": "^2.15"}, "devDependencies": {"jest": "^29.0.0"}}',
            "yarn.lock": "",
            "tools/quote.js": "const f = require('../format')\nimport('./table')\n",
            "tools/table.mjs": "export { pad } from '../format/pad'\n",
            "format.ts": "export const f = 1\n",
            "format/pad.ts": "export const pad = 1\n",
            "web/board.tsx": "import { pad } from '../format/pad'\nimport React from 'react'\nexport default pad\n",
        },
    )


@pytest.fixture(scope="session")
def clinic(tmp_path_factory):
    """Commands from all sources, a long file with a tangled function, and calls that skip a layer."""
    tangled = "async def triage(sick):\n" + "".join("    " * (i + 1) + f"while sick > {i}:\n" for i in range(6)) + "    " * 7 + "pass  # FIXME rename\n"
    return write(
        tmp_path_factory.mktemp("t") / "clinic",
        {
            "requirements.txt": "# pinned\n--index-url x\nsqlalchemy~=2.0\npytest==7.4 # runner\nrequests\nPyTest\n",
            "setup.py": "x\n",
            "package.json": '{"scripts": {"dev": "vite", "test": "vitest run (once)"}}',
            "package-lock.json": "{}",
            "Makefile": "# all\ninstall: # tools\n\t# nothing yet\n\tpoetry install && echo ok\ntest:\n\t@pytest -q\nlint: test\n\truff .\ndev:\ninstall:\n\tsecond\n",
            ".github/workflows/b.yml": "jobs:\n  - run: npm ci\n  - name: x\n  -  run:  make INSTALL  \n",
            ".github/workflows/a.yaml": "- run: tox -e test\n- run: pytest\n",
            ".github/workflows/deep/c.yml": "- run: install nothing\n",
            "ward.py": tangled + lines(420, "bed_{} = 0"),
            "web/VisitController.java": "public class VisitController {\n    private VisitDao dao;\n    void show() { dao.load(); }\n    public static class Page {\n        void draw() { render(); }\n    }\n}\n",
            "web/VisitDao.java": "class VisitDao {\n    void load() {}\n}\n",
            "test/ward_test.py": "def test_ward():\n    assert 1  # TODO more, TODO better\n",
        },
    )
