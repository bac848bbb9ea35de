"""Column layouts, report headers and code tables shared by the whole library."""

from __future__ import annotations

from pyspark.sql import types as T

# Flight record layout, report headers, cause names and cancellation
# codes. They have to be spelled this way for results to line up with existing ones.
FLIGHT_COLUMNS = {
    "month": T.LongType(),
    "fl_date": T.TimestampType(),
    "op_unique_carrier": T.StringType(),
    "op_carrier_fl_num": T.DoubleType(),
    "origin": T.StringType(),
    "dest": T.StringType(),
    "dep_delay": T.DoubleType(),
    "arr_delay": T.DoubleType(),
    "cancelled": T.LongType(),
    "cancellation_code": T.StringType(),
    "carrier_delay": T.DoubleType(),
    "weather_delay": T.DoubleType(),
    "nas_delay": T.DoubleType(),
    "security_delay": T.DoubleType(),
    "late_aircraft_delay": T.DoubleType(),
}
RAW_EXTRA_COLUMNS = {"year": T.LongType(), "diverted": T.LongType()}

DELAY_COLUMNS = ("dep_delay", "arr_delay")
CAUSE_COLUMNS = {
    "Carrier": "carrier_delay",
    "Weather": "weather_delay",
    "NAS": "nas_delay",
    "Security": "security_delay",
    "Late Aircraft": "late_aircraft_delay",
}
CANCELLATION_CODES = {"A": "Carrier", "B": "Weather", "C": "NAS", "D": "Security"}

ROUTE_MONTH_HEADER = [
    "codice",
    "aeroporto_partenza",
    "numero_voli",
    "ritardo_minimo",
    "ritardo_massimo",
    "ritardo_medio",
    "tasso_cancellazione",
    "mese",
]
DELAY_BAND_HEADER = [
    "aeroporto_partenza",
    "mese",
    "numero_ritardi_basso",
    "dep_avg_basso",
    "arr_avg_basso",
    "numero_ritardi_medio",
    "dep_avg_medio",
    "arr_avg_medio",
    "numero_ritardo_alto",
    "dep_avg_alto",
    "arr_avg_alto",
    "cause_maggiori",
]
CARRIER_DEVIATION_HEADER = [
    "aeroporto_partenza",
    "compagnia",
    "numero_voli",
    "ritardo_medio_partenza",
    "ritardo_medio_arrivo",
    "tasso_cancellazione",
    "differenza",
    "classifica",
]
# End of fixed values.

# Cleaning band in minutes, delay band edges, dataset scales and seed.
DELAY_FLOOR, DELAY_CEILING = -30.0, 1440.0
BAND_EDGES = (15.0, 60.0)
SCALES = (0.10, 0.25, 0.50, 0.75, 1.0, 1.5)
SAMPLE_SEED = 42
CLUSTER_OVERHEAD_SECONDS = 600
# End of fixed values.

MEAN = T.DecimalType(10, 2)
RATE = T.DecimalType(10, 1)


def struct_of(columns: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


FLIGHTS = struct_of(FLIGHT_COLUMNS)
RAW_FLIGHTS = struct_of({**RAW_EXTRA_COLUMNS, **FLIGHT_COLUMNS})

ROUTE_MONTH_REPORT = struct_of(
    dict(
        zip(
            ROUTE_MONTH_HEADER,
            [
                T.StringType(),
                T.StringType(),
                T.LongType(),
                T.DoubleType(),
                T.DoubleType(),
                MEAN,
                RATE,
                T.LongType(),
            ],
        )
    )
)
DELAY_BAND_REPORT = struct_of(
    dict(
        zip(
            DELAY_BAND_HEADER,
            [T.StringType(), T.LongType()] + [T.LongType(), MEAN, MEAN] * 3 + [T.StringType()],
        )
    )
)
CARRIER_DEVIATION_REPORT = struct_of(
    dict(
        zip(
            CARRIER_DEVIATION_HEADER,
            [
                T.StringType(),
                T.StringType(),
                T.LongType(),
                MEAN,
                MEAN,
                RATE,
                MEAN,
                T.IntegerType(),
            ],
        )
    )
)

# Identifying columns of each report, in the order its rows are sorted.
ROUTE_MONTH_KEY = ["codice", "aeroporto_partenza", "mese"]
DELAY_BAND_KEY = ["aeroporto_partenza", "mese"]
CARRIER_DEVIATION_KEY = ["aeroporto_partenza", "compagnia"]

# Run log as stored on disk, and as used by the run comparisons.
RUN_LOG_FILE = struct_of(
    {
        "Percentuale": T.StringType(),
        "Analisi": T.StringType(),
        "Tecnologia": T.StringType(),
        "Tempo_Secondi": T.DoubleType(),
        # Start in microseconds; logs written elsewhere end before this column.
        "Inizio": T.LongType(),
    }
)
