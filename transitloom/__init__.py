"""transitloom: transit crowding and itinerary analytics as Spark DataFrame jobs."""
