import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from skyledger import session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    spark = (SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4")
             .config("spark.checkpoint.dir", f"file://{shared}")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    yield session.configure(spark)
    spark.stop()


@pytest.fixture(scope="session")
def layered(spark):
    from skyledger.plans.layers import layers

    return layers(spark, SF_DIR)


COLUMNS = [
    "event_id", "flight_id", "airline", "airline_iata", "flight_number", "source_airport", "dest_airport",
    "latitude", "longitude", "altitude", "speed", "heading", "status", "delay_minutes", "event_timestamp",
    "loaded_at", "source",
]
SCHEMA = ("event_id string, flight_id string, airline string, airline_iata string, flight_number string, "
          "source_airport string, dest_airport string, latitude double, longitude double, altitude int, speed double, "
          "heading double, status string, delay_minutes int, event_timestamp string, loaded_at string, source string")


@pytest.fixture(scope="session")
def tidy_flights(spark):
    """Three valid rows."""
    loaded = "2024-06-15T10:05:00Z"
    rows = [
        ("E001", "AI101", "Air India", "AI", "101", "DEL", "BOM", 22.3, 73.1, 35000, 850.0, 213.0, "active", 0,
         "2024-06-15T10:00:00Z", loaded, "simulator"),
        ("E002", "6E202", "IndiGo", "6E", "202", "BOM", "BLR", 15.1, 74.9, 28000, 780.0, 190.0, "active", 15,
         "2024-06-15T10:01:00Z", loaded, "simulator"),
        ("E003", "SG303", "SpiceJet", "SG", "303", "CCU", "HYD", 22.6, 88.4, 15000, 650.0, 270.0, "active", 45,
         "2024-06-15T10:02:00Z", loaded, "simulator"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def messy_flights(spark):
    """Six rows with every kind of defect."""
    loaded = "2024-06-15T10:05:00Z"
    rows = [
        ("E001", "AI101", "  air india  ", "AI", "101", "DEL", "BOM", 22.3, 73.1, 35000, 850.0, 213.0, "active", 0,
         "2024-06-15T10:00:00Z", loaded, "simulator"),
        ("E002", None, "indigo", "6E", "202", "BOM", "BLR", 15.1, 74.9, 28000, 780.0, 190.0, "IN_AIR", 15,
         "2024-06-15T10:01:00Z", loaded, "simulator"),
        ("E002", "SG303", "SPICEJET", "SG", "303", "???", "HYD", None, 78.4, -500, 0.0, None, "ghost", None,
         "2024-06-15T10:02:00Z", loaded, "simulator"),
        ("E003", "UK404", "Vistara", "UK", "404", "DEL", "BOM", 999.0, 77.1, 0, -999.0, 45.0, "active", -5,
         "2024-06-15T10:03:00Z", loaded, "simulator"),
        ("E004", "EK505", "Emirates", "EK", "505", "BOM", "DXB", 28.5, 72.8, 38000, 900.0, 270.0, "active", 45,
         "2024-06-15T10:04:00Z", loaded, "simulator"),
        ("E005", "QR606", "Qatar", "QR", "606", "del", "SIN", 1.36, 103.9, 35000, 875.0, 90.0, "landed", 0,
         "2024-06-15T10:05:00Z", loaded, "simulator"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture()
def scratch(spark):
    return lambda label: session.new_path(spark, label)
