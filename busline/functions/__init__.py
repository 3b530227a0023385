"""busline.functions"""
