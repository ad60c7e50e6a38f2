"""Hand-made domain tables (written as CSV) for golden tests.

Interchange rows come in +/- pairs: every day nets to zero. Golden values
below are worked out by hand from these rows.
"""

import os

RESOURCES_CSV = """id_recurso;guid_recurso;subsistema
1;g1;SE
2;g2;SE
3;g3;S
4;g4;N
"""

GENERATION_CSV = """data;valor;id_usina;guid_usina
2018-01-01T00:00:00.000Z;1000.0;1;g1
2018-01-01T00:00:00.000Z;5000.5;2;g2
2018-01-01T00:00:00.000Z;300.25;3;g3
2018-01-01T00:00:00.000Z;10.0;9;g9
2018-01-02T00:00:00.000Z;1200.0;1;g1
2018-01-02T00:00:00.000Z;4000.0;2;g2
2018-01-02T00:00:00.000Z;0.0;3;g3
2018-02-01T00:00:00.000Z;7.0;4;g4
"""

INTERCHANGE_CSV = """data;subsistema;valor
2018-01-01T00:00:00.000Z;SE;1500.5
2018-01-01T00:00:00.000Z;SE;-200.25
2018-01-01T00:00:00.000Z;S;-1300.25
2018-01-01T00:00:00.000Z;N;400.0
2018-01-01T00:00:00.000Z;NE;-400.0
2018-01-01T00:00:00.000Z;AR;-0.0
2018-01-02T00:00:00.000Z;SE;-900.0
2018-01-02T00:00:00.000Z;S;600.0
2018-01-02T00:00:00.000Z;S;300.0
2018-01-02T00:00:00.000Z;N;0.0
2018-01-02T00:00:00.000Z;N;0.0
2018-01-03T00:00:00.000Z;SE;50.0
2018-01-03T00:00:00.000Z;S;-50.0
"""

# Golden values. Keys: (subsystem, day of January 2018) or (subsystem,).
INTERCHANGE_DAILY = {("SE", 1): 1300.25, ("S", 1): -1300.25, ("N", 1): 400.0,
                     ("NE", 1): -400.0, ("AR", 1): 0.0, ("SE", 2): -900.0, ("S", 2): 900.0,
                     ("N", 2): 0.0, ("SE", 3): 50.0, ("S", 3): -50.0}
INTERCHANGE_MONTHLY = {"SE": 112.5625, "S": -112.5625, "N": 400.0 / 3, "NE": -400.0, "AR": 0.0}
GENERATION_MONTHLY = {"SE": 2800.125, "S": 150.125, "N": 7.0}
LOAD_DAILY = {("S", 1): 1600.5, ("S", 2): -900.0, ("SE", 1): 4700.25, ("SE", 2): 6100.0}
LOAD_MONTHLY = {"SE": 2687.5625, "S": 262.6875, "N": 7.0 - 400.0 / 3}


def write(workdir, name, text):
    path = os.path.join(workdir, name)
    with open(path, "w") as f:
        f.write(text)
    return path
