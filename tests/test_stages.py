"""The three stages on small generated inputs, against plain loops over the same rows."""

import csv
import datetime as dt
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.plans import names as N
from caseloom.plans import stages

OUTCOMES = ["Towing", "Scheduled Towing", "Jump Start", "Cancelled", None]
COMPONENTS = ["Battery", "Clutch", "Brakes - Hydraulic brake system, regulator ", None]
MODELS = [("T1", "911", "911 I", "g1"), ("T2", "Macan", "Macan II", "g2"), ("T2", "Macan", "Macan II", "g2")]


def _write(path, columns, rows):
    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(columns)
        out.writerows([["" if r.get(c) is None else r[c] for c in columns] for r in rows])


def _make_inputs(folder):
    rng = random.Random(42)
    vins = [f"V{i:02d}" for i in range(40)]
    calls, lines, ends = [], [], []
    for i in range(700):
        vin = "V00" if rng.random() < 0.2 else rng.choice(vins)
        day = dt.date(2021, 1, 1) + dt.timedelta(days=rng.randrange(1000))
        minute = rng.randrange(24 * 60 - 60)
        arrival = minute + rng.randrange(0, 60)
        start = day - dt.timedelta(days=rng.randrange(0, 900))
        row = {c: None for c in N.RAW_CALL_COLUMNS}
        row.update(
            {
                "Case Number": f"C{i % 650}",
                "VIN": vin if rng.random() > 0.02 else None,
                "Report Type": rng.choice(["A", "B"]),
                "Incident Date": day.strftime("%d/%m/%Y"),
                "Time Of Call": f"{minute // 60:02d}:{minute % 60:02d}",
                "Time Of Arrival": rng.choice(["0", "00:00", f"{arrival // 60}:{arrival % 60:02d}"]),
                "Registration Date": rng.choice([start.strftime("%Y%m%d"), "28/05/2921", None, "01/02/1930"]),
                "Policy Start Date": start.strftime("%d/%m/%Y"),
                "Policy End Date": (day + dt.timedelta(days=rng.randrange(-60, 500))).strftime("%Y%m%d"),
                "Reason Of Call": rng.choice(["1", "3", "Flat battery"]),
                "Odometer": rng.choice(["20", "20000", "20001.5", "250000", "300000", "x"]),
                "Btype": rng.choice(["T1", "T2", "T9", None]),
                "Typ aus VIN": rng.choice(["911", "Macan", "Unknown"]),
                "Country Of Origin": rng.choice(["DE", "NO", "N", "FR"]),
                "Country Of Incident": rng.choice(["DE", "IT"]),
                "Handling Call Center": rng.choice(["x", "y"]),
                "Component": rng.choice(COMPONENTS),
                "Outcome Description": rng.choice(OUTCOMES),
                "Damage During Assistance": rng.choice(["YES", "NO", None]),
                "Telephone Help": rng.choice(["yes", "NO", None]),
                "Service Paid By Customer": rng.choice(["YES", None]),
                "Replacement Car Days": rng.choice([None, "0", "2", "3.5"]),
                "Fault Description Customer": rng.choice(["Batterie leer, \"Tür\" zu", "engine 12 noise"]),
            }
        )
        for s in N.SERVICES:
            row[s] = rng.choice(["YES", "no", "NO", None, None, "n/a"] if s == "Taxi Service" else ["YES", "no", None])
        row["_year"] = ("2021", "2022", "2023")[i % 3]
        calls.append(row)
    calls += [dict(c) for c in calls[:15]]
    for i in range(400):
        day = dt.date(2021, 1, 1) + dt.timedelta(days=rng.randrange(1000))
        lines.append({"Q-Line": f"Q{i:03d}", "FIN": rng.choice(vins), "Reparaturbeginndatum": day.strftime("%Y%m%d"), "Werkstattaufenthalt": f"W{rng.randrange(300)}"})
        if i % 20:
            ends.append({"Q-Line": f"Q{i:03d}", "Reparaturendedatum": (day + dt.timedelta(days=rng.randrange(0, 12))).strftime("%Y%m%d")})
    lines += [dict(line) for line in lines[:9]]
    back = {v: k for k, v in N.CALL_RENAMES.items()}
    for year in ("2021", "2022", "2023"):
        drift = {"2021": [], "2022": ["Report Type"], "2023": ["Country Of Origin"]}[year]
        rows = [{back.get(k, k) if k in drift else k: v for k, v in c.items()} for c in calls if c["_year"] == year]
        columns = [back.get(c, c) if c in drift else c for c in N.RAW_CALL_COLUMNS]
        if year == "2023":
            columns = ["a", *[c for c in columns if c != "Monat"], "b"]
        _write(f"{folder}/assistance_{year}.csv", columns, rows)
    _write(f"{folder}/qlines.csv", ["Q-Line", "FIN", "Reparaturbeginndatum", "Werkstattaufenthalt"], lines)
    _write(f"{folder}/qlines_repair_end.csv", ["Q-Line", "Reparaturendedatum"], ends)
    _write(
        f"{folder}/vehicle_model.csv",
        ["Bestelltypschlüssel", "Bestelltyp", "Baureihe", "Modellreihe", "Fahrzeuggruppe"],
        [dict(zip(["Bestelltypschlüssel", "Baureihe", "Modellreihe", "Fahrzeuggruppe"], m)) for m in MODELS],
    )
    return calls, lines, ends


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    source, target = tmp_path_factory.mktemp("in"), str(tmp_path_factory.mktemp("out"))
    inputs = _make_inputs(source)
    grids = {"suspects": {"maxIter": [3], "maxDepth": [2]}, "merged": {"numTrees": [4], "maxDepth": [3]}}
    stages.run(spark, stages.STAGES, str(source), target, train_model=True, grids=grids, folds=2)

    def table(name):
        return spark.read.parquet(f"{target}/{name}")

    return table, inputs, target


def _moment(row):
    day = dt.datetime.strptime(row["Incident Date"], "%d/%m/%Y")
    hours, minutes = map(int, row["Time Of Call"].split(":"))
    return day + dt.timedelta(hours=hours, minutes=minutes)


def _expected_calls(calls):
    """First call of each vehicle and moment, in input order."""
    kept = {}
    for row in sorted(calls, key=lambda r: r["_year"]):
        kept.setdefault((row["VIN"], _moment(row)), row)
    return kept


def test_cleaned_calls(run):
    table, (calls, _, _), _ = run
    want = _expected_calls(calls)
    got = table("interim/calls").collect()
    assert Counter((r["VIN"], r["Incident Date"]) for r in got) == Counter(list(want))
    for r in got:
        raw = want[r["VIN"], r["Incident Date"]]
        assert r["Case Number"] == raw["Case Number"] and r["Report Type"] == raw["Report Type"]
        assert r["Country Of Origin"] == raw["Country Of Origin"]
        known = raw["Btype"] in ("T1", "T2")
        model = {"T1": "911 I", "T2": "Macan II"}.get(raw["Btype"]) or {"911": "911 I", "Macan": "Macan II"}.get(raw["Typ aus VIN"])
        assert r["Modellreihe"] == model
        assert r["Fahrzeuggruppe"] == ({"T1": "g1", "T2": "g2"}[raw["Btype"]] if known else None)
        odometer = {"20000": (20000.0, "0-20000"), "20001.5": (20001.5, "20000-40000"), "250000": (250000.0, None)}
        assert (r["Odometer"], r["Odometer_Binned"]) == odometer.get(raw["Odometer"], (None, None))
        assert r["Taxi Service"] == (raw["Taxi Service"] in ("YES", "n/a"))
        assert r["Reason Of Call"] == {"1": "Breakdown - Technical defect", "3": "Accident"}.get(raw["Reason Of Call"], raw["Reason Of Call"])
        if raw["Time Of Arrival"] in ("0", "00:00"):
            assert r["CTA"] is None
        else:
            h, m = map(int, raw["Time Of Arrival"].split(":"))
            h0, m0 = map(int, raw["Time Of Call"].split(":"))
            assert r["CTA"] == ((h * 60 + m) - (h0 * 60 + m0) or None)
        registered = raw["Registration Date"]
        assert (r["Registration Date"] is None) == (registered in (None, "28/05/2921", "01/02/1930"))
        end = dt.datetime.strptime(raw["Policy End Date"], "%Y%m%d").date()
        start = dt.datetime.strptime(raw["Policy Start Date"], "%d/%m/%Y").date()
        assert r["Policy End Date"] == (end if end > start else None)


def _tow(outcome):
    return outcome in ("Towing", "Scheduled Towing")


def _expected_cases(rows):
    by_vin = defaultdict(list)
    for r in rows:
        if r["VIN"] is not None:
            by_vin[r["VIN"]].append(r)
    cases = {}
    for vin, own in by_vin.items():
        number, before = 0, None
        for r in sorted(own, key=lambda r: r["Incident Date"]):
            if before is None or (r["Incident Date"] - before["Incident Date"]).days > 6 or _tow(before["Outcome Description"]):
                number += 1
            cases[vin, r["Incident Date"]] = f"{vin}_{number}"
            before = r
    return cases


def _expected_stays(lines, ends):
    end_of = {e["Q-Line"]: dt.datetime.strptime(e["Reparaturendedatum"], "%Y%m%d").date() for e in ends}
    unique = {line["Q-Line"]: line for line in reversed(lines)}
    by_vin = defaultdict(list)
    for q, line in unique.items():
        if q in end_of:
            start = dt.datetime.strptime(line["Reparaturbeginndatum"], "%Y%m%d").date()
            by_vin[line["FIN"]].append((start, q, line["Werkstattaufenthalt"], end_of[q]))
    stays = {}
    for vin, own in by_vin.items():
        number, before = 0, None
        for start, q, stay, end in sorted(own):
            if before is None or not (stay == before[2] or (start - before[0]).days <= 7):
                number += 1
            stays[q] = (vin, start, end, f"{vin}_{number}")
            before = (start, q, stay)
    return stays


def test_links_and_scores(run):
    table, (_, lines, ends), _ = run
    rows = table("interim/calls").collect()
    case_of = _expected_cases(rows)
    stays = _expected_stays(lines, ends)
    assert {r["Q-Line"]: r["Aufenthalt_ID"] for r in table("interim/workshop").collect()} == {q: s[3] for q, s in stays.items()}
    assert {(r["VIN"], r["Incident Date"]): r["Fall_ID"] for r in rows if r["VIN"]} == case_of

    first = {}
    for q, (vin, start, _, stay) in stays.items():
        if stay not in first or (start, q) < first[stay][:2]:
            first[stay] = (start, q, vin)
    in_case = defaultdict(list)
    for r in rows:
        if r["VIN"]:
            in_case[case_of[r["VIN"], r["Incident Date"]]].append(r)
    links, sweep = {}, Counter()
    for case, own in in_case.items():
        own.sort(key=lambda r: r["Incident Date"])
        for i, r in enumerate(own):
            tow = _tow(r["Outcome Description"])
            if not tow and (any(_tow(o["Outcome Description"]) for o in own) or i < len(own) - 1):
                continue
            ahead = [(s, q, stay) for stay, (s, q, v) in first.items() if v == r["VIN"] and s >= r["Incident Date"].date()]
            if ahead:
                s, q, stay = min(ahead)
                days = (s - r["Incident Date"].date()).days
                for t in range(31):
                    sweep[tow, t] += days <= t
                if days <= (7 if tow else 3):
                    links[r["VIN"], r["Incident Date"]] = (q, stay)
    merged = {(r["VIN"], r["Incident Date"]): (r["Q-Line"], r["Aufenthalt_ID"]) for r in table("interim/merged").collect() if r["Q-Line"]}
    assert merged == links
    assert {r["tolerance_days"]: r["matches"] for r in table("output/num_merges").collect()} == {t: sweep[True, t] for t in range(1, 31)}
    assert {r["tolerance_days"]: r["matches"] for r in table("output/num_merges_not_on_towing").collect()} == {
        t: sweep[False, t] for t in range(0, 10)
    }
    bridge = Counter((case_of[k], v[1]) for k, v in links.items())
    assert Counter(map(tuple, table("interim/fall_id_to_aufenthalt_id").collect())) == bridge

    scored = table("interim/assistance").collect()
    assert len(scored) == len(rows)
    linked_cases = {r["Case Number"] for r in rows if (r["VIN"], r["Incident Date"]) in links}
    per_vin = defaultdict(lambda: Counter())
    for r in rows:
        if r["VIN"]:
            c = per_vin[r["VIN"]]
            c["calls"] += 1
            c["services"] += sum(r[s] for s in N.SERVICES)
            c["rentals"] += (r["Rental Car Days"] or 0) > 0
            c["tows"] += _tow(r["Outcome Description"])
    for vin in per_vin:
        per_vin[vin]["cases"] = len({c for (v, _), c in case_of.items() if v == vin})

    def limit(what, p, positive=False):
        return np.quantile([c[what] for c in per_vin.values() if c[what] or not positive], p)

    limits = {
        "calls": limit("calls", 0.8), "services": limit("services", 0.9), "cases": limit("cases", 0.75),
        "rentals": limit("rentals", 0.75, True), "tows": limit("tows", 0.75, True),
    }
    previous = {}
    by_vin = defaultdict(list)
    for r in rows:
        by_vin[r["VIN"]].append(r["Incident Date"])
    for vin, times in by_vin.items():
        times.sort()
        previous.update({(vin, b): a for a, b in zip(times, times[1:])})
    counts = []
    for r in scored:
        c, key, at = per_vin.get(r["VIN"]), (r["VIN"], r["Incident Date"]), r["Incident Date"]
        tow = _tow(r["Outcome Description"])
        start, end = (d and dt.datetime(d.year, d.month, d.day) for d in (r["Policy Start Date"], r["Policy End Date"]))
        month = dt.timedelta(days=30)
        want = {
            "SuS_Anruferzahl": bool(c) and c["calls"] >= limits["calls"],
            "SuS_Services_Offered": bool(c) and c["services"] >= limits["services"],
            "SuS_AnrufeInFall": bool(c) and c["cases"] > limits["cases"],
            "SuS_Rental_Car": bool(c) and c["rentals"] > limits["rentals"],
            "SuS_Abschleppungen": bool(c) and c["tows"] > 0 and c["tows"] >= limits["tows"],
            "SuS_Vertragszeitraum": bool((start and start <= at <= start + month) or (end and at >= end - month)),
            "SuS_Breakdown": tow and r["VIN"] is not None and key in previous and (at - previous[key]).days <= 14,
            "SuS_Merged": tow and r["Case Number"] not in linked_cases,
            "SuS_Call_while_car_in_workshop": any(
                v == r["VIN"]
                and dt.datetime(s.year, s.month, s.day) + dt.timedelta(days=1) < at < dt.datetime(e.year, e.month, e.day)
                for v, s, e, _ in stays.values()
            ),
        }
        assert {f: r[f] for f in N.FLAGS} == {f: bool(want[f]) for f in N.FLAGS}
        assert r["flags_set"] == sum(map(bool, want.values()))
        counts.append(r["flags_set"])
    top = np.quantile(counts, 0.9)
    assert all(r["Suspect"] == (r["flags_set"] >= top) for r in scored)
    unlinked = Counter(
        (case_of[r["VIN"], r["Incident Date"]], r["VIN"], r["Incident Date"])
        for r in rows
        if r["VIN"] and _tow(r["Outcome Description"]) and case_of[r["VIN"], r["Incident Date"]] not in {c for c, _ in bridge}
    )
    got = Counter((r["Fall_ID"], r["VIN"], r["Incident Date"]) for r in table("interim/unmerged_fall_ids").collect() if r["VIN"])
    assert got == unlinked


def test_reports_are_written(run):
    table, _, _ = run
    total = table("interim/assistance").count()
    assert table("output/analysis/timeline").agg(F.sum("n")).first()[0] == total
    assert table("output/analysis/countries_Country_Of_Origin").count() == 4
    assert table("output/analysis/correlation").count() == 64
    left = table("output/analysis/correlation_rows").first()
    assert left["kept"] + left["dropped"] == table("interim/assistance").filter("`Damage During Assistance` IS NOT NULL").count()
    assert table("output/analysis/chi_square_Component_Reason_Of_Call").first()["dof"] == 4
    counted = table("output/analysis/counts_Component").agg(F.sum("n")).first()[0]
    assert counted == table("interim/assistance").filter("Component IS NOT NULL").count()
    assert table("output/analysis/vehicle_normal_curve").count() == 100
    assert table("output/score_histogram").agg(F.sum("n")).first()[0] == total


def test_learning_outputs(run):
    table, _, _ = run
    vehicles = table("interim/features").count()
    assert table("interim/clustered").count() == vehicles
    for name in ("suspect", "merged"):
        assert 0 <= table(f"output/learning/{name}_auc").first()["auc"] <= 1
        assert table(f"output/learning/{name}_importances").agg(F.sum("importance")).first()[0] == pytest.approx(1.0)
    silhouettes = table("output/learning/vehicle_silhouettes")
    assert silhouettes.join(table("interim/clustered"), ["VIN", "cluster"]).count() == vehicles
    # Only a model that was fitted here has the scores it was chosen by.
    chosen = table("output/learning/silhouette_scores").agg(F.max("silhouette")).first()[0]
    assert silhouettes.agg(F.avg("silhouette")).first()[0] == pytest.approx(chosen, abs=1e-6)
    assert table("output/learning/profile").filter("feature = 'Anzahl_Anrufe'").count() > 0


def test_models_are_reused_and_missing_ones_named(spark, run, tmp_path):
    _, _, target = run
    stages.run(spark, ["machine_learning"], "unused", target, train_model=False)
    with pytest.raises(ValueError, match="unknown stages"):
        stages.run(spark, ["nothing"], "unused", target)
