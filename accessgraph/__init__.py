"""Place, access-network, track and terrain analytics on the PySpark DataFrame API."""
