"""busline: packet-flow analytics for in-vehicle service networks, on Spark."""
