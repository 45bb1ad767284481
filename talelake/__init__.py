"""talelake package of the narrative-workspace analytics library."""
