import pytest

from simgrove import cli
from simgrove.sources.files import read_corpus


#: Extractors that workers can import: bytes as text, and one that fails on every file here.
PLAIN, BROKEN = "os:fsdecode", "json:loads"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    for k, word in enumerate(("cats", "dogs", "birds")):
        body = f"A study of {word}. " * 40
        (tmp_path / "in" / f"{k}.TXT").write_text(f"Title {k}\nAna Ruiz, Ben Cho\nAbstract\n{body}\nKeywords\n{word}\n")
    return tmp_path


def test_commands_from_folder_to_verified_corpus(spark, folder, capsys):
    out = f"{folder}/corpus.json"
    assert cli.main(["ingest", f"--input={folder}/in", f"--output={out}", "--suffix=txt", f"--extractor={BROKEN}", f"--fallback={PLAIN}"], spark) == 0
    said = capsys.readouterr().out
    assert "Ingested 3 document(s)" in said and f"  d01 [{PLAIN}] Title 0" in said and "chars - ok" in said
    head, docs = read_corpus(spark, out)
    assert head.first()["sourceCount"] == 3 and [r.title for r in docs.orderBy("corpus_order").collect()] == ["Title 0", "Title 1", "Title 2"]

    assert cli.main(["verify", f"--corpus={out}"], spark) == 1
    said = capsys.readouterr().err
    assert "3 violation(s)" in said and "  [d02] MANUALLY_VALIDATED: " in said
    assert cli.main(["validate", f"--corpus={out}", "--ids=d01, d03"], spark) == 0 and "2/3" in capsys.readouterr().out
    assert cli.main(["validate", f"--corpus={out}", "--all"], spark) == 0 and "3/3" in capsys.readouterr().out
    assert cli.main(["verify", f"--corpus={out}"], spark) == 0 and capsys.readouterr().out == f"verify: OK ({out})\n"
    assert cli.main(["verify", f"--corpus={out}", "--expected=4"], spark) == 1 and "[corpus] DOCUMENT_COUNT_MATCHES_EXPECTED" in capsys.readouterr().err
    assert not (folder / "corpus.json.new").exists() and not (folder / "corpus.json.old").exists()


def test_commands_that_fail_leave_the_corpus(spark, folder, capsys):
    out = f"{folder}/corpus.json"
    cli.main(["ingest", f"--input={folder}/in", f"--output={out}", "--suffix=txt", f"--extractor={PLAIN}"], spark)
    capsys.readouterr()
    for args in (["--ids=d01,d09"], ["--ids= ,"], []):
        assert cli.main(["validate", f"--corpus={out}", *args], spark) == 1 and "validate failed" in capsys.readouterr().err
    assert cli.main(["ingest", f"--input={folder}/in", f"--output={out}", "--suffix=pdf", f"--extractor={PLAIN}"], spark) == 1
    assert cli.main(["ingest", f"--input={folder}/in", f"--output={out}", "--suffix=txt", f"--extractor={BROKEN}"], spark) == 1
    assert read_corpus(spark, out)[1].count() == 3
