"""A fake service: its works are in a file, the requests it got in another. Workers import this module by its name."""

import json

FOLDER = "/tmp/athenor-fake-service"


def works():
    with open(FOLDER + "/works.json") as file:
        return json.load(file)


def client(request):
    with open(FOLDER + "/requests", "a") as file:
        file.write(json.dumps(request) + "\n")
    found = [w for w in works() if request.get("search", "").lower() in w["title"].lower() and request.get("year_min", 0) <= w["year"] <= request.get("year_max", 9999) and request.get("id", w["id"]) == w["id"]]
    if request.get("sort") == "cited_by_count:desc":
        found.sort(key=lambda w: -w["cited"])
    size = request["per_page"]
    at = (request["page"] - 1) * size if "page" in request else 0 if request["cursor"] == "*" else int(request["cursor"])
    more = at + size if at + size < len(found) else None
    return {"results": [[w["id"], w["title"], w["year"], w["cited"], json.dumps(w)] for w in found[at : at + size]], "count": len(found), "next": None if more is None else str(more)}
