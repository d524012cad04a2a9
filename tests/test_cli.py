import json

from vacantia.__main__ import main


def test_import_search_and_audit(spark, tmp_path, capsys):
    job = {"id": "lever:a:1", "company": "A", "title": "Backend Engineer", "location": "Pune", "remote": False, "workMode": "onsite", "eligibleCountries": ["IN"], "excludedCountries": [], "eligibleRegions": [], "eligibilityConfidence": "explicit", "url": "u", "updatedAt": "2026-08-30", "description": "Java"}
    (tmp_path / "s.json").write_text(json.dumps({"version": 1, "updatedAt": "x", "partitions": {"a": {"fetchedAt": "2026-08-31T00:00:00Z", "jobs": [job]}}}))
    (tmp_path / "c.json").write_text(json.dumps({"a": {"name": "A", "ats": "lever", "token": "a", "companyDomain": "a.com", "cohorts": ["IN"]}}))
    data = ["--data", f"{tmp_path}/d", "--now", "2026-09-01T00:00:00"]
    assert main(["import", *data, "--snapshot", f"{tmp_path}/s.json", "--catalog", f"{tmp_path}/c.json"]) == 0
    main(["search", *data, "--input", '{"query": "backend"}'])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["jobs"][0]["id"] == "lever:a:1"
    main(["audit", *data, "--input", '{"country": "IN"}'])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["totals"][0]["eligible_jobs"] == 1
    main(["coverage", *data, "--input", '{"countries": ["IN"]}'])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["coverage"][0]["jobs"] == 1
    resume = "# Jo\n## Skills\nJava\n## Experience\nBackend Engineer at Beta 2015 to 2019"
    said = lambda *given: main([given[0], *data, "--input", json.dumps(given[1])]) or json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert said("watch", {"name": "w", "resume": {"content": resume, "format": "markdown"}})["already_live"] == 1
    assert said("watches", {})["watches"] == [{"name": "w", "holds": said("watches", {})["watches"][0]["holds"], "seen": 1}] and said("check", {"name": "w"})["total_new"] == 0
    assert said("stop", {"name": "w"}) == {"stopped": True} and said("watches", {})["watches"] == []
    assert said("sources", {"slugs": ["a"]})[0]["state"] == "fresh"
    assert [(r["source_slug"], r["jobs"]) for r in said("export", {"path": f"{tmp_path}/x"})] == [("a", 1)]
