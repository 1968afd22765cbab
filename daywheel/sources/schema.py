"""Fixed values of the station data model."""

# Measure columns of a station file, by how a day's rows are aggregated.
MEAN_MEASURES = (
    "TEMPERATURA_MAXIMA",
    "TEMPERATURA_MIN",
    "UMIDADE_MAX",
    "UMIDADE_MIN",
    "PRESSAO_MAX",
    "PRESSAO_MIN",
    "VELOCIDADE_VENTO",
    "DIRECAO_VENTO",
    "RAJADA_VENTO",
)
SUM_MEASURES = ("PRECIPITACAO_TOTAL", "RADIACAO")

DATE = "Data"
RAW_DATE = "DATA"
RAIN = "PRECIPITACAO_TOTAL"
STATION = "station_id"
