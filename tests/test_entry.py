import __spark_entry__ as entry


def test_queries_and_sql_agree():
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and len(names) >= 35


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() == 2


def test_the_library_stands_without_the_corpus_folder():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('vacantia.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError('gone', name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert not [n for n in e.queries() if n.startswith('op') or n == 'pipeline'] and e.oracle_sql()\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
    assert not [p for p in (root / "vacantia").rglob("*.py") if "llm" not in p.parts and ("vacantia.llm" in p.read_text() or "..llm" in p.read_text() or "from .llm" in p.read_text())]
