"""skyloom: interferometric imaging, array dataflow and log analytics as Spark queries."""
