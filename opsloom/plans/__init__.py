"""Named queries over the test tables, grouped by kind; each module has QUERIES and ORACLE."""

from opsloom.plans import detection, graphs, log_text, ml, records, relational, timeseries
from opsloom.streaming import jobs

MODULES = [timeseries, relational, graphs, log_text, detection, ml, records, jobs]
