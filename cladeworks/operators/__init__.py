"""Set algebra, scoring, dynamic programming and comparison over trees."""
