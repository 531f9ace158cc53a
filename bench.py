"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from loftline.plans import catalog
from loftline.session import build_session

HEADLINE = ("miss_summary", "closeout", "tendencies", "weighted_median", "evidence", "hole_review", "match_points", "last5_rolling", "strokes_gained",
            "expected_strokes", "plain_pick", "lww_merge", "import_upsert", "surface_classify", "raster_bin", "plane_fit", "weather_asof", "trail_stops", "recency_weights",
            "aggression_scorecard", "idw_elevation", "overlay_merge", "lie_confidence")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus), **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    qs = catalog.queries()
    qs["closeout"](spark, folder).limit(1).count()   # start-up is not part of any query
    out = {}
    for name in HEADLINE:
        t = time.time()
        qs[name](spark, folder).write.format("noop").mode("overwrite").save()
        out[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
