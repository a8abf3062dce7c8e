"""All reference queries and their SQL, collected from the plan modules."""

from opsloom.plans import MODULES

QUERIES: dict = {}
ORACLE: dict = {}
for _m in MODULES:
    QUERIES |= _m.QUERIES
    ORACLE |= _m.ORACLE
